"""URL filtering with a bit-parallel wildcard automaton.

Glob rules are packed side by side into the bits of a few 64-bit words (Shift-And with gap masks): one step per character of the
canonical URL advances every rule at once, for a whole Arrow batch of URLs together; the few that are longer than all others are finished one by one, with
the same masks as one long integer. `*` stands for any run of characters without
`/`, `**` for any run at all; a rule must match the whole canonical URL, which is the host in lower case followed by the path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, read_table


@dataclass(frozen=True)
class Rule:
    """Action for a host with its subdomains and a path prefix; `name` as reports show it."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


#: The host and path rules of the query, and the globs that decide where none of them fits.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
BLOCKED_GLOBS = ("*spam*", "*spam*/**", "*casino*", "*casino*/**", "*cheap-*", "*cheap-*/**", "*pills*", "*pills*/**", "*adult*", "*adult*/**", "**/ads/**", "**/login**")


#: With no more URLs left than this, one by one is faster than side by side.
FEW = 64


class GlobAutomaton:
    """All globs simulated at once. match(strings) returns a bool matrix strings x globs."""

    def __init__(self, globs):
        tokens = []
        for g in globs:
            parts, i, data = [], 0, g.encode()
            while i < len(data):
                if data[i : i + 2] == b"**":
                    parts.append(2)
                    i += 2
                elif data[i : i + 1] == b"*":
                    parts.append(1)
                    i += 1
                else:
                    parts.append(data[i : i + 1])
                    i += 1
            tokens.append(parts)
        n = sum(1 + sum(isinstance(p, bytes) for p in t) for t in tokens)
        self.words = max(1, -(-n // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # states that character c leads into
        self.stay = np.zeros((256, self.words), np.uint64)  # states whose gap takes character c
        self.start = np.zeros(self.words, np.uint64)
        self.final = []
        at = 0

        def put(table, state):
            table[..., state // 64] |= np.uint64(1) << np.uint64(state % 64)

        for parts in tokens:
            put(self.start, at)
            for p in parts:
                if isinstance(p, bytes):
                    at += 1
                    put(self.step[p[0]], at)
                else:
                    for c in range(256):
                        if p == 2 or c != ord("/"):
                            put(self.stay[c], at)
            self.final.append(at)
            at += 1
        self.long_step, self.long_stay = ([int.from_bytes(row.astype("<u8").tobytes(), "little") for row in table] for table in (self.step, self.stay))

    def finish(self, state: np.ndarray, rest: bytes) -> np.ndarray:
        """The state after the bytes of `rest`; ends early where no byte can lead anywhere."""
        now = int.from_bytes(state.astype("<u8").tobytes(), "little")
        step, stay = self.long_step, self.long_stay
        for c in rest:
            now = (now << 1) & step[c] | now & stay[c]
            if not now:
                break
        return np.frombuffer(now.to_bytes(8 * self.words, "little"), "<u8").astype(np.uint64)

    def match(self, strings: list[bytes]) -> np.ndarray:
        length = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-length, kind="stable")
        flat = np.frombuffer(b"".join(strings), np.uint8)
        offset = (np.cumsum(length) - length)[order]
        length = length[order]
        state = np.tile(self.start, (len(strings), 1))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(length[0]) if len(length) else 0):
            k = int(np.searchsorted(-length, -t, "left"))  # strings longer than t
            if k <= FEW:
                for i in range(k):
                    state[i] = self.finish(state[i], strings[order[i]][t:])
                break
            c = flat[offset[:k] + t]
            now = state[:k]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:k] = (moved & self.step[c]) | (now & self.stay[c])
        out = np.empty((len(strings), len(self.final)), bool)
        for j, f in enumerate(self.final):
            out[order, j] = (state[:, f // 64] >> np.uint64(f % 64)) & one
        return out


def filter_urls(pages: DataFrame, rules=RULES, blocked_globs=BLOCKED_GLOBS, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict added.

    A null url, or one without `://`, has an empty host and path. Of the rules that fit, the longest wins, the first given on a
    tie; where none fits the verdict is block if a glob of blocked_globs matches, else allow. Rows, order and other columns are
    kept; clashing columns of the input are replaced.
    """
    rules, blocked_globs = tuple(rules), tuple(blocked_globs)
    ranked = sorted(rules, key=lambda r: -len(r.name))
    auto = GlobAutomaton([g for r in ranked for g in r.globs()] + list(blocked_globs))  # a few kilobytes of masks, sent with the task

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        hit = auto.match([(h + p).encode("utf-8", "surrogatepass") for h, p in zip(host, path)])
        rule = np.full(len(host), None, object)
        verdict = np.where(hit[:, 2 * len(ranked) :].any(axis=1), "block", "allow").astype(object)
        for j in reversed(range(len(ranked))):
            fits = hit[:, 2 * j] | hit[:, 2 * j + 1]
            rule[fits], verdict[fits] = ranked[j].name, ranked[j].action
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    url = F.coalesce(F.col(url_col), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    parted = pages.withColumns({"host": ascii_lower(F.regexp_extract(url, pattern, 1)), "path": F.regexp_extract(url, pattern, 2)})
    kept = [c for c in parted.columns if c not in ("rule", "verdict")]
    return parted.select(*kept, judge("host", "path").alias("__j")).select(*kept, "__j.rule", "__j.verdict")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict. Null and empty urls have an empty host and path and are judged by the globs; repeated rows are
    judged each for itself. Time grows with the sum of the urls' lengths, also where one of them is very long."""
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_FITS = "(path LIKE '{path}%' AND (host = '{host}' OR host LIKE '%.{host}'))"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r.name))
_METHOD = " OR ".join(f"contains(host, '{w}')" for w in ("spam", "casino", "cheap-", "pills", "adult")) + " OR contains(path, '/ads/') OR contains(path, '/login')"
ORACLE = {
    "op6_url_filter": f"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        r AS (SELECT *, CASE {' '.join(f"WHEN {_FITS.format(path=r.path, host=r.host)} THEN '{r.name}'" for r in _BY_LENGTH)} END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r.name}' THEN '{r.action}'" for r in RULES)}
               WHEN {_METHOD} THEN 'block' ELSE 'allow' END AS verdict FROM r
    """
}
QUERIES = {"op6_url_filter": op6_url_filter}

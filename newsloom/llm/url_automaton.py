"""Bit-parallel wildcard automaton for URL rules.

Glob rules are laid out one after the other in a row of 64-bit words, one bit per symbol and one start bit per rule.
For each byte value a mask says which symbols accept it and another which stars it leaves waiting; one step of
``D' = (D << 1) & accept[c] | D & wait[c]`` advances every rule at once. A batch of URLs is advanced together: the longest
come first, so that at each byte position the URLs still running are a head of the batch.

A URL is read as host (in lower case), a boundary byte, path (as it stands). ``*`` stands for any run and ``?`` for one byte, neither crosses the
boundary, so a host rule cannot be met inside a path.

Defined results: host and path of a null url, or one without ``://``, are empty, fit no rule and are allowed; very long
urls cost one step per byte; equal rows get equal verdicts; an empty table gives no rows; other columns are kept, but for
columns named host, path, rule or verdict, whose place the results take.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import as_row

EDGE = 0x0A
#: Fixed values: (verdict, host, path) of the rules that hold for a host and all its subdomains.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Globs over host and path, in either case, that block what no rule decides. The part before the blank is the host.
BLOCKED = [
    "*spam* *", "*casino* *", "*cheap-pills* *", "*pills.* *", "*porn* *", "*xxx* *", "*betting* *", "ads.* *", "ads-* *", "*.ads.* *", "*.ads-* *", "adserver* *",
    "*.adserver* *", "tracker* *", "*.tracker* *", "*-track.* *", "doubleclick.* *", "*.doubleclick.* *", "*malware* *", "*phishing* *", "*torrent* *",
    "* */ads/*", "* */adult/*", "* */casino/*", "* */banner?/*", "* */tracking/*", "* */wp-login*", "* */cgi-bin/*", "* *.exe", "* *.apk",
    "* *.msi", "* *.dmg", "* *.iso", "* *.torrent",
]


class Globs:
    """A set of globs as step masks; ``matches`` gives a URLs x globs table of booleans."""

    def __init__(self, globs: list[tuple[str, str, bool]]):
        bits: list[tuple[set[int], set[int]]] = []  # what a symbol accepts, what waits on it
        self.start, self.final = [], []
        every = set(range(256)) - {EDGE}
        for host, path, any_case in globs:
            bits.append((set(), set()))
            self.start.append(len(bits) - 1)
            for c in [*host.encode(), EDGE, *path.encode()]:
                if c == ord("*"):
                    bits[-1] = (bits[-1][0], every)
                else:
                    one = every if c == ord("?") else {c}
                    bits.append(({*one, *bytes([c]).swapcase()} if any_case else set(one), set()))
            self.final.append(len(bits) - 1)
        self.words = -(-len(bits) // 64)
        self.accept, self.wait = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        for k, (yes, stay) in enumerate(bits):
            for masks, chars in ((self.accept, yes), (self.wait, stay)):
                masks[sorted(chars), k // 64] |= np.uint64(1 << (k % 64))

    def matches(self, urls: list[bytes]) -> np.ndarray:
        n = len(urls)
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        first = (np.cumsum(size) - size)[order]
        running = n - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), side="right")
        state = np.zeros((n, self.words), np.uint64)
        for k in self.start:
            state[:, k // 64] |= np.uint64(1 << (k % 64))
        for p, m in enumerate(running):
            c = flat[first[:m] + p]
            d = state[:m]
            step = d << np.uint64(1)
            step[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:m] = (step & self.accept[c]) | (d & self.wait[c])
        out = np.empty((n, len(self.final)), bool)
        for j, k in enumerate(self.final):
            out[order, j] = (state[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) != 0
        return out


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, blocked=BLOCKED) -> DataFrame:
    """Adds ``host, path, rule, verdict``: the longest fitting rule decides, else any blocked glob, else allow."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    globs = [g for _, h, p in ranked for g in ((h, p + "*", False), ("*." + h, p + "*", False))]
    globs += [(*b.split(" ", 1), True) for b in blocked]
    names, says = [h + p for _, h, p in ranked], [v for v, _, _ in ranked]
    n = len(ranked)

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        machine = judged_machine()
        clean = lambda s: s.encode("utf-8", "replace").replace(b"\n", b"\0")
        hits = machine.matches([clean(h) + b"\n" + clean(p) for h, p in zip(host, path, strict=True)])
        fits = hits[:, : 2 * n].reshape(len(host), n, 2).any(axis=2)
        rule = np.where(fits.any(axis=1), fits.argmax(axis=1), n) if n else np.full(len(host), n)
        other = np.where(hits[:, 2 * n :].any(axis=1), "block", "allow")
        return pd.DataFrame({"rule": [names[r] if r < n else None for r in rule],
                             "verdict": [says[r] if r < n else o for r, o in zip(rule, other, strict=True)]})

    built: list[Globs] = []

    def judged_machine() -> Globs:
        if not built:
            built.append(Globs(globs))
        return built[0]

    rows = pages.select(as_row(pages), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("judged", judged("host", "path"))
    kept = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return rows.select(*kept, "host", "path", "judged.rule", "judged.verdict")

"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words. A rule of m symbols has m + 1 states, one bit each; a step shifts
every state to the next symbol (carries run across words), keeps those that the character allows, and adds the states
whose wildcard loops on it. All rules are simulated at once on each canonical url, and all urls of a batch step together.

Globs: `*` is any run without `/`, `**` any run, `?` one character; all else stands for itself. A canonical url is
`.host/path?query`: lower-cased host (A to Z), no scheme, no fragment, characters beyond ASCII as their UTF-8 bytes.
A `*` with no `/`, `**` or `?` before it stands in the host: it stops at `?` as well, which follows the host where the path
is empty, so that no host pattern is met inside a query string.

The longest matching rule decides, block before allow at equal length. Defined results: null or a url without `://` has
an empty host and path and is matched as an empty text, so only rules of wildcards fit; the verdict is then `default`.
Repeated urls are judged each; empty tables stay empty; extra columns stay. Very long urls take one step per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "allow"


@dataclass(frozen=True)
class Glob:
    pattern: str
    verdict: str


def host_rule(rule: str, verdict: str) -> Glob:
    """`rule` is host/path: the host and its subdomains, with a path that starts with the rule's."""
    return Glob(f"*.{rule}**", verdict)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A to Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)


def canonical(url: Column) -> Column:
    whole = F.concat(F.lit("."), host_of(url), path_of(url), query_of(url))
    return F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("://")), whole).otherwise(F.lit(""))


class Automaton:
    """Masks of all rules: `after[c]` the states that c leads into, `loop[c]` those that stay on c."""

    def __init__(self, globs: list[str]) -> None:
        states, starts, ends = [], [], []
        for glob in globs:
            starts.append(len(states))
            states.append([None, None])
            text, at, host = glob.encode(), 0, True
            while at < len(text):
                if text[at:at + 2] == b"**":
                    states[-1][1], at, host = "any", at + 2, False
                elif text[at:at + 1] == b"*":
                    states[-1][1], at = states[-1][1] or ("host" if host else "part"), at + 1
                else:
                    host = host and text[at] not in b"/?"
                    states.append([text[at], None])
                    at += 1
            ends.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.first = self._mask(starts)
        self.ends = [(end // 64, np.uint64(end % 64)) for end in ends]
        self.after = np.zeros((256, self.words), dtype=np.uint64)
        self.loop = np.zeros((256, self.words), dtype=np.uint64)
        stops = {"any": "", "part": "/", "host": "/?"}
        for c in range(256):
            self.after[c] = self._mask(i for i, (symbol, _) in enumerate(states) if symbol is not None and symbol in (c, ord("?")))
            self.loop[c] = self._mask(i for i, (_, run) in enumerate(states) if run and chr(c) not in stops[run])

    def _mask(self, bits) -> np.ndarray:
        mask = np.zeros(self.words, dtype=np.uint64)
        for bit in bits:
            mask[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        return mask

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """urls x rules, true where the rule matches the whole url."""
        sizes = np.array([len(url) for url in urls], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(urls), dtype=np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        state = np.tile(self.first, (len(urls), 1))
        active = len(urls)
        for step in range(int(sizes.max(initial=0))):
            while active and sizes[order[active - 1]] <= step:
                active -= 1
            seen, now = data[starts[:active] + step], state[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.after[seen]) | (now & self.loop[seen])
        found = np.empty((len(urls), len(self.ends)), dtype=bool)
        for rule, (word, bit) in enumerate(self.ends):
            found[order, rule] = (state[:, word] >> bit) & np.uint64(1) == 1
        return found


def best_rules(globs: list[Glob], lengths: list[int] | None = None):
    """Pandas UDF over canonical urls: index of the deciding rule, null where none matches."""
    ranks = sorted(range(len(globs)), key=lambda i: (-(lengths or [len(g.pattern) for g in globs])[i], globs[i].verdict != "block", i))
    patterns = [globs[i].pattern for i in ranks]

    @F.pandas_udf("int")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(patterns)
        for urls in batches:
            found = automaton.matches([url.encode() for url in urls])
            first = np.where(found.any(axis=1), np.array(ranks)[found.argmax(axis=1)], -1) if len(urls) else np.zeros(0, dtype=int)
            yield pd.Series(first, dtype="int32")

    return decide


def filtered(pages: DataFrame, rules: list[tuple[str, str]], globs: list[Glob], default: str = DEFAULT) -> DataFrame:
    """`pages` (with url) plus host, path, rule, verdict and pattern; columns of these names are replaced.

    `rules` are (host/path, verdict) pairs and go before the `globs`; one automaton runs both. `rule` is the deciding
    host rule, else null; `pattern` is the glob that decided where no host rule did, else null.
    """
    if not rules and not globs:
        raise ValueError("no rules")
    packed = [host_rule(*rule) for rule in rules] + list(globs)
    lengths = [(1 << 20) + len(rule) for rule, _ in rules] + [len(glob.pattern) for glob in globs]
    decide = best_rules(packed, lengths)
    verdicts = F.array(*[F.lit(glob.verdict) for glob in packed])
    names = F.array(*[F.lit(rule) for rule, _ in rules], *[F.lit(None).cast("string") for _ in globs])
    patterns = F.array(*[F.lit(None).cast("string") for _ in rules], *[F.lit(glob.pattern) for glob in globs])
    judged = pages.withColumn("__rule", F.nullif(decide(canonical(F.col("url"))), F.lit(-1)))
    return judged.withColumns({
        "host": host_of(F.col("url")), "path": path_of(F.col("url")),
        "rule": F.get(names, F.col("__rule")), "verdict": F.coalesce(F.get(verdicts, F.col("__rule")), F.lit(default)),
        "pattern": F.get(patterns, F.col("__rule")),
    }).drop("__rule")

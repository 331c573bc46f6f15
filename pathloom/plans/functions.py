"""SQL table functions: windows, suffixes and containment, callable after register(spark)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pathloom.functions.sequences import SEP
from pathloom.operators.match import PatternTrie


@udtf(returnType="key string, n int")
class SeqWindows:
    def eval(self, seq: list, least: int, most: int):
        seen = set()
        for i in range(len(seq or [])):
            for n in range(least, min(most, len(seq) - i) + 1):
                w = tuple(seq[i : i + n])
                if w not in seen:
                    seen.add(w)
                    yield SEP.join(w), n


@udtf(returnType="bucket string, prev string, suffix array<string>")
class SeqSuffixes:
    def eval(self, seq: list, prefix: int, most: int):
        for i in range(len(seq or []) - prefix + 1):
            yield SEP.join(seq[i : i + prefix]), seq[i - 1] if i else None, seq[i : i + most]


@udtf(returnType="pattern int")
class MatchPatterns:
    """Numbers of the patterns (joined keys) that the sequence holds."""

    def __init__(self):
        self.key, self.trie = None, None

    def eval(self, seq: list, patterns: list):
        key = tuple(patterns or ())
        if key != self.key:
            self.key, self.trie = key, PatternTrie([tuple(p.split(SEP)) for p in key])
        for i in sorted(self.trie.matches(seq or [])):
            yield (i,)


def register(spark: SparkSession) -> None:
    for name, f in (("seq_windows", SeqWindows), ("seq_suffixes", SeqSuffixes), ("match_patterns", MatchPatterns)):
        spark.udtf.register(name, f)

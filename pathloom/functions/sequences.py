"""Sequences of tokens as array columns: compaction, gaps, windows, n-grams, suffixes, shingles, transitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.config import MAX_CELL_REVISITS, SUFFIX_MAX_CELLS, SUFFIX_PREFIX_CELLS
from pathloom.functions.geo import cell_hop_km

SEP = ">"


def compact(seq: Column) -> Column:
    """Drops consecutive repeats; later revisits stay.  No lambda refers to seq: it is worked out once a row, not once an element."""
    before = F.slice(F.concat(F.array(F.lit(None)), seq), F.lit(1), F.size(seq))
    pairs = F.zip_with(seq, before, lambda x, p: F.struct(x.alias("x"), p.alias("p")))
    return F.transform(F.filter(pairs, lambda s: s["p"].isNull() | (s["x"] != s["p"])), lambda s: s["x"])


def _pairs(seq: Column, f) -> Column:
    n = F.size(seq)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(seq, F.lit(1), n - 1), F.slice(seq, F.lit(2), n - 1), f))


def hops_km(cells: Column) -> Column:
    """Ground distance of each step between neighbouring cells of the sequence."""
    return _pairs(cells, lambda a, b: cell_hop_km(a, b))


def prefix_sums(values: Column) -> Column:
    """[0, v1, v1 + v2, ...]: one longer than values."""
    return F.aggregate(values, F.array(F.lit(0.0)), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))


def split_at_gaps(cells: Column, hops: Column, max_hop_km: float) -> Column:
    """Array of arrays: cut where a hop exceeds the bound, stretches of fewer than two cells dropped."""
    starts = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.greatest(F.size(cells) - 1, F.lit(1))), lambda i: F.get(hops, i - 1) > max_hop_km))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(cells)))
    parts = F.zip_with(starts, ends, lambda s, e: F.slice(cells, s + 1, e - s))
    return F.when(F.size(cells) < 2, F.array().cast("array<array<string>>")).otherwise(F.filter(parts, lambda p: F.size(p) >= 2))


def revisits_ok(cells: Column, most: int = MAX_CELL_REVISITS) -> Column:
    """No cell is entered more than `most` times; true for an empty sequence.  In sorted order, no cell equals the one `most` places on."""
    n, order = F.size(cells) - most, F.array_sort(cells)
    apart = F.zip_with(F.slice(order, F.lit(1), F.greatest(n, F.lit(0))), F.slice(order, F.lit(most + 1), F.greatest(n, F.lit(0))), lambda a, b: a == b)
    return ~F.exists(apart, lambda same: same)


def ngrams(seq: Column, n: int) -> Column:
    """Distinct n-grams as joined keys."""
    last = F.size(seq) - n
    keys = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(seq, i + 1, F.lit(n)), SEP))
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def windows_up_to(seq: Column, least: int, most: int) -> Column:
    """Distinct windows of least to most tokens, as struct(key, n)."""
    n = F.size(seq)
    per = F.transform(
        F.sequence(F.lit(0), F.greatest(n - least, F.lit(0))),
        lambda i: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), n - i)), lambda k: F.struct(F.array_join(F.slice(seq, i + 1, k), SEP).alias("key"), k.alias("n"))),
    )
    return F.when(n < least, F.array().cast("array<struct<key:string,n:int>>")).otherwise(F.array_distinct(F.flatten(per)))


def windows_km(cells: Column, cum: Column, least_km: float, most_km: float, revisits: int = MAX_CELL_REVISITS) -> Column:
    """Windows of a gap-free segment whose ground length lies within the bounds: struct(key, length_km, n, truncated).

    truncated: one more cell exists on the right and would pass most_km.
    """
    n = F.size(cells)

    def span(i: Column, j: Column) -> Column:
        return F.get(cum, j) - F.get(cum, i)

    def at(i: Column) -> Column:
        ends = F.filter(F.sequence(i + 1, n - 1), lambda j: (span(i, j) >= least_km) & (span(i, j) <= most_km))
        return F.transform(
            ends,
            lambda j: F.struct(i.alias("i"), (j - i + 1).alias("n"), span(i, j).alias("length_km"), F.coalesce(span(i, j + 1) > most_km, F.lit(False)).alias("truncated")),
        )

    # Places first, then the guard, and cells of the windows that are left: no array of all windows' cells.
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), at))
    own = lambda w: F.slice(cells, w["i"] + 1, w["n"])
    good = F.filter(every, lambda w: revisits_ok(own(w), revisits))
    out = F.transform(good, lambda w: F.struct(F.array_join(own(w), SEP).alias("key"), w["length_km"].alias("length_km"), w["n"].alias("n"), w["truncated"].alias("truncated")))
    return F.when(n < 2, F.array().cast("array<struct<key:string,length_km:double,n:int,truncated:boolean>>")).otherwise(out)


def suffixes(seq: Column, prefix: int = SUFFIX_PREFIX_CELLS, most: int = SUFFIX_MAX_CELLS) -> Column:
    """struct(bucket, prev, suffix) at each start with at least `prefix` tokens left."""
    n = F.size(seq)
    out = F.transform(
        F.sequence(F.lit(0), F.greatest(n - prefix, F.lit(0))),
        lambda i: F.struct(
            F.array_join(F.slice(seq, i + 1, F.lit(prefix)), SEP).alias("bucket"),
            F.get(seq, i - 1).alias("prev"),
            F.slice(seq, i + 1, F.lit(most)).alias("suffix"),
        ),
    )
    return F.when(n < prefix, F.array().cast("array<struct<bucket:string,prev:string,suffix:array<string>>>")).otherwise(out)


def transitions(seq: Column) -> Column:
    """Distinct (f, t) steps."""
    n = F.size(seq)
    steps = F.zip_with(F.slice(seq, F.lit(1), n - 1), F.slice(seq, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("f"), b.alias("t")))
    return F.when(n < 2, F.array().cast("array<struct<f:string,t:string>>")).otherwise(F.array_distinct(steps))


def shingles(seq: Column) -> Column:
    """Distinct directed bigrams "a>b".  No lambda refers to seq, which is worked out a few times, not once an element."""
    n = F.size(seq)
    pairs = F.zip_with(F.slice(seq, F.lit(1), n - 1), F.slice(seq, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(SEP), b))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def parent_left(key: Column) -> Column:
    """The key without its first token."""
    return F.regexp_extract(key, f"^[^{SEP}]*{SEP}(.*)$", 1)


def parent_right(key: Column) -> Column:
    """The key without its last token."""
    return F.regexp_extract(key, f"^(.*){SEP}[^{SEP}]*$", 1)


def contains_run(seq: Column, pattern: Column) -> Column:
    """Whether the joined pattern occurs in the sequence, token by token."""
    wrapped = F.concat(F.lit(SEP), F.array_join(seq, SEP), F.lit(SEP))
    return F.contains(wrapped, F.concat(F.lit(SEP), pattern, F.lit(SEP)))

"""URL rules by Bloom filter cascades: exact membership without joins.

A rule is a host and the beginning of a path. The keys that could be a rule for a url are the url's host or one of its
domains (as many labels as some rule has) with the first characters of its path (as many as some rule has). The
universe of a cascade is the set of all these keys over the whole corpus.

Level 1 of a cascade is a Bloom filter of the listed keys; level 2 one of those keys of the universe that pass level 1
without being listed; level 3 one of the listed keys that pass level 2; and so on, until a level lets nothing wrong pass.
A key is listed exactly if the number of levels that it passes, up to the first that it fails, is odd. The universe is
never gathered: each level's bits are or-ed together per partition and then by word. A level's size follows from the
number of keys it encodes and is checked before it is sent to the tasks.

One cascade says which keys are rules, a second which of the rules block. Each url takes the longest listed key (by host
and path together, then by host). A url that no rule fits gets the method's own verdict: it is not listed, so ``allow``.
Null urls and urls without :// have empty host and path. Null rules are left out; of equal rules, block wins. The columns
host, path, rule and verdict of pages are replaced; all others stay as they are and never leave the JVM.

More rules than one cascade may hold in a task's memory (see bloom.LARGEST_LEVEL) are cut by the hashes of their keys into
parts with a cascade each; the parts are asked one after the other, each about all different (host, path) of the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .bloom import LARGEST_LEVEL, Level, build, n_bytes
from .scratch import sent

PAIR = kernels.U64(0xFF51AFD7ED558CCD)

#: Host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def listed(levels: list[Level], h: np.ndarray) -> np.ndarray:
    """Whether keys of the universe, given by their hashes, are listed."""
    deep, alive = np.zeros(len(h), np.int64), np.ones(len(h), bool)
    for level in levels:
        alive &= level.passes(h)
        deep += alive
    return deep % 2 == 1


def hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of strings; the empty string has one too."""
    buf, offs = kernels.raw(keys)
    return kernels.mix(kernels.slice_hashes(kernels.prefix_sums(buf), offs[:-1], offs[1:]) ^ np.diff(offs).astype(kernels.U64))


def cascade(inside: DataFrame, outside: DataFrame, keep, most_levels: int = 64) -> list[Level]:
    """Levels for the keys inside against those outside (columns h, distinct and disjoint)."""
    spark, levels = inside.sparkSession, []
    now, other = inside, outside
    n, m = now.count(), other.count()
    while n:
        if len(levels) == most_levels:
            raise RuntimeError("the cascade does not end")
        error = min(0.5, max(1e-6, n / max(m, 1) * 0.5**0.5)) if not levels else 0.5
        while error < 0.5 and n_bytes(n, error) > LARGEST_LEVEL:
            error = min(0.5, 2 * error)  # more false positives, for the next level
        level = build(now, n, error, len(levels) + 1)
        levels.append(level)
        with sent(spark, level) as shared:
            now, other = keep(other.mapInArrow(_passing(shared), "h long"), "false-positives"), now
        n, m = now.count(), n
    return levels


def _passing(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.passes(b.column(0).to_numpy().view(kernels.U64))))

    return run


def _ends(host: Column, path: Column, labels: list[int], lengths: list[int]) -> tuple[Column, Column]:
    """The hosts and the beginnings of paths that a rule for a url could have: its keys are all pairs of them."""
    parts = F.split(host, r"\.", -1)
    domains = F.array_distinct(F.filter(F.array(*(F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in labels)), lambda x: x.isNotNull()))
    return domains, F.filter(F.array(*(F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths)), lambda x: x.isNotNull())


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", part_rules: int = 20_000_000, *, keep) -> DataFrame:
    """pages with the columns host, path, rule and verdict. rules: host, path, verdict (allow or block).

    The distinct numbers of labels of rule hosts and of characters of rule paths bound the keys tried for a url.
    """
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    pages = pages.select(*own, host.alias("host"), path.alias("path"))
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = keep(rules.mapInArrow(_hash_rules, "host string, path string, verdict string, h long"), "rules")
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\.", -1))), F.collect_set(F.length("path")), F.count("*")).first()
    labels, lengths, n = sorted(shape[0]), sorted(shape[1]), shape[2]
    if not n:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    sections = pages.select("host", F.substring("path", 1, max(lengths)).alias("path")).distinct()  # once a site section, not once a page
    ends = _ends(F.col("host"), F.col("path"), labels, lengths)
    universe = sections.select(F.explode(ends[0]).alias("d"), ends[1].alias("p")).select("d", F.explode("p").alias("p")).distinct()
    universe = keep(universe.mapInArrow(_hash_keys, "h long").distinct(), "universe")
    parts = -(-n // part_rules)
    if parts == 1:
        found = _judge_udf(pages.sparkSession.sparkContext.broadcast(_cascades(rules, universe, keep)), 1, 0)(*ends)
        judged = pages.withColumn("__found", found) if "__found" not in pages.columns else pages.withColumn("__found_", found)
        name = judged.columns[-1]
        return judged.select(*pages.columns, F.col(name)["rule"].alias("rule"), F.coalesce(F.col(name)["verdict"], F.lit(default)).alias("verdict"))
    sections, answers = keep(sections, "sections"), None
    for k in range(parts):
        here = F.pmod(F.col("h"), F.lit(parts)) == k
        with sent(pages.sparkSession, _cascades(rules.where(here), universe.where(here), keep)) as shared:
            found = _judge_udf(shared, parts, k)(*ends)
            one = keep(sections.withColumn("found", found).where("found.rule is not null"), "found")
        answers = one if answers is None else answers.unionByName(one)
    longest = F.max_by("found", F.struct(F.length("found.rule"), F.col("found.host_length")))
    answers = answers.groupBy("host", "path").agg(longest.alias("found")).select(F.col("host").alias("h"), F.col("path").alias("p"), "found")
    judged = pages.join(answers, (pages["host"] == answers["h"]) & (F.substring(pages["path"], 1, max(lengths)) == answers["p"]), "left")
    return judged.select(*(pages[f"`{c}`"] for c in pages.columns), answers["found"]["rule"].alias("rule"), F.coalesce(answers["found"]["verdict"], F.lit(default)).alias("verdict"))


def _cascades(rules: DataFrame, universe: DataFrame, keep) -> tuple[list[Level], list[Level]]:
    """Which keys are rules, and which of the rules block."""
    inside, blocks = rules.select("h").distinct(), rules.where("verdict = 'block'").select("h").distinct()
    return cascade(inside, universe.join(inside, "h", "left_anti"), keep), cascade(blocks, inside.join(blocks, "h", "left_anti"), keep)


def _judge_udf(shared, parts: int, part: int):
    """The longest of a url's keys that is listed (of equal ones that with the longer host): (rule, verdict, host_length)."""

    @F.arrow_udf("rule string, verdict string, host_length int")
    def found(domains: pa.Array, starts: pa.Array) -> pa.Array:
        rule, block = shared.value
        n_d, n_p = domains.value_lengths().to_numpy().astype(np.int64), starts.value_lengths().to_numpy().astype(np.int64)
        pairs = n_d * n_p
        row = np.repeat(np.arange(len(pairs)), pairs)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = (np.cumsum(n_d) - n_d)[row] + inner // np.maximum(n_p[row], 1), (np.cumsum(n_p) - n_p)[row] + inner % np.maximum(n_p[row], 1)
        d, p = domains.flatten(), starts.flatten()
        h = kernels.mix(hashes(d)[i] * PAIR + hashes(p)[j])
        hit = np.flatnonzero(listed(rule, h) & (h.view(np.int64) % parts == part))
        host_length, length = (pc.utf8_length(x).to_numpy() for x in (d, p))
        order = np.lexsort((-host_length[i[hit]], -host_length[i[hit]] - length[j[hit]], row[hit]))
        where, first = np.unique(row[hit][order], return_index=True)
        at = hit[order][first]
        best = np.full(len(pairs), -1)
        best[where] = at
        none = best < 0
        best[none] = 0
        verdict = np.full(len(pairs), None, object)
        verdict[where] = np.where(listed(block, h[at]), "block", "allow")
        host, start = (x.take(pa.array(k[best] if len(k) else best, mask=none)) for x, k in ((d, i), (p, j)))
        return pa.StructArray.from_arrays([pc.binary_join_element_wise(host, start, ""), pa.array(verdict, pa.string()), pc.utf8_length(host)], ["rule", "verdict", "host_length"])

    return found


def _pair_hash(host: pa.Array, path: pa.Array) -> np.ndarray:
    return kernels.mix(hashes(host) * PAIR + hashes(path))


def _hash_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_pair_hash(b.column(0), b.column(1)).view(np.int64))], ["host", "path", "verdict", "h"])


def _hash_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_pair_hash(b.column(0), b.column(1)).view(np.int64))], ["h"])

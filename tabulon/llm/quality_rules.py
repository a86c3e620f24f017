"""Quality rules decided per host, in DataFrame operations only.

Each document is measured by rules; failures are counted per host; a host's failure rate by a rule is
shrunk towards the corpus by an empirical beta prior (method of moments over the hosts; its strength is held between 1
and STRONGEST documents, so that a corpus of alike hosts does not drown a bad one); a host
whose shrunk rate reaches TIMES the prior's mean, but LEAST at least and MOST at most, is rejected, and its verdict is
joined back to its documents.

Defined cases: a null or empty text has no words and fails the base rules; a document without a
host (null) gets no host verdict; repeated rows are judged one by one; an empty table gives an
empty result; other input columns are ignored, so their names cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, SPACES, fresh, let, stored, words_of

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A host is rejected at so many times the usual failure rate, within these bounds.
TIMES, LEAST, MOST = 3.0, 0.3, 0.6
STRONGEST = 1000.0


def word_counts(words: Column, span: int = 3) -> Column:
    """struct(n_words, n_repeat_words); the latter counts words that lie in windows of span words found twice or more in the array.

    Windows are sorted with their positions; equal neighbours are repeats; the positions kept
    are then merged, each adding the words that the window before does not cover.  Texts whose windows
    all have different hashes, so no repeat, skip the sort."""

    def windows(w: Column) -> Column:
        text = lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, span)])
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (span - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.struct(text(x, i).alias("w"), i.alias("i")))

    def repeats(s: Column) -> Column:
        same = lambda e, other: e["w"].eqNullSafe(other["w"])
        both = F.filter(s, lambda e, i: same(e, F.get(s, i - 1)) | same(e, F.get(s, i + 1)))
        return F.sort_array(F.transform(both, lambda e: e["i"]))

    def covered(p: Column) -> Column:
        new = F.transform(p, lambda x, i: F.least(F.lit(span), x - F.coalesce(F.get(p, i - 1), F.lit(-span))))
        return F.aggregate(new, F.lit(0), lambda total, x: total + x)

    def exact(w: Column) -> Column:
        return let(F.sort_array(windows(w)), lambda s: let(repeats(s), covered))

    def hashes(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (span - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, span)]))

    def counted(w: Column) -> Column:
        return F.when(let(hashes(w), lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(exact(w))

    return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), counted(w).cast("long").alias("n_repeat_words")))


def counted(text: str, host: str) -> list[Column]:
    """host and the counts that rules look at, those of words in one struct."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    return [
        F.col(host).alias("host"),
        word_counts(words_of(F.col(text))).alias("w"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def flat(counts: DataFrame) -> DataFrame:
    return counts.select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def measured(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: key, host and the counts that rules look at."""
    return flat(docs.select(F.col(key).alias("doc_id"), *counted(text, host)))


def host_rates(stats: DataFrame, failed: dict[str, Column]) -> DataFrame:
    """Per host: n documents and failures of each rule (partial sums before the shuffle)."""
    counts = [F.sum(c.cast("long")).alias(f"f_{name}") for name, c in failed.items()]
    return stats.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *counts)


def beta_prior(hosts: DataFrame, rule: str, most: float = STRONGEST) -> tuple[float, float]:
    """Mean and strength of the beta prior of a rule's failure rate, by moments over the hosts.

    Only these sums reach the driver, one row whatever the input."""
    rate = F.col(f"f_{rule}") / F.col("n")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if mean is None:
        return 0.0, most
    if var <= 1e-12:
        return mean, most
    return mean, min(most, max(1.0, mean * (1 - mean) / var - 1))


def base_failed(n_words: Column, n_repeat_words: Column, min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (n_words < min_words) | (100 * n_repeat_words > repeat_percent * n_words)


def failures() -> dict[str, Column]:
    """Each rule's verdict on a document, from its counts."""
    base = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return {"base": base, "symbols": 10 * F.col("n_symbols") > 3 * F.col("n_words"), "lines": 4 * F.col("n_dup_lines") > F.col("n_words")}


def host_verdicts(stats: DataFrame) -> DataFrame:
    """(host, host_docs, host_failed, host_rejected) from document counts."""
    hosts = stored(host_rates(stats, failures()))
    bad = F.lit(False)
    for rule in failures():
        mean, strength = beta_prior(hosts, rule)
        limit = min(MOST, max(LEAST, TIMES * mean))
        bad = bad | ((F.col(f"f_{rule}") + mean * strength) / (F.col("n") + strength) >= limit)
    return hosts.select("host", F.col("n").alias("host_docs"), F.col("f_base").alias("host_failed"), bad.alias("host_rejected"))


def judged(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """Document counts with base_failed, the host's shrunk verdict and kept."""
    stats = stored(measured(docs, text, host, key))
    # A plain join: a hot host is split by adaptive execution, a small host table is broadcast by its measured size.
    out = stats.join(host_verdicts(stats), "host", "left").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return out.withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~rejected)


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, that judged() keeps.  Words are counted once: the rows go to the shared folder with
    their counts, those that fail without their text."""
    mark, spoilt = (fresh(x, docs.columns) for x in ("_counts", "_fails"))
    counts = docs.withColumn(mark, F.struct(*counted(text, host)))
    counts = counts.withColumn(spoilt, base_failed(F.col(f"{mark}.w.n_words"), F.col(f"{mark}.w.n_repeat_words")))
    held = stored(counts.withColumn(text, F.when(~F.col(spoilt), F.col(text))))
    stats = flat(held.select(F.lit(None).cast("long").alias("doc_id"), f"{mark}.*"))
    rejected = host_verdicts(stats).where("host_rejected").select(F.col("host").alias("_rejected_host"))
    kept = held.where(~F.col(spoilt)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.join(rejected, kept[host] == F.col("_rejected_host"), "left_anti")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_docs", "host_failed", "host_rejected"]
    return judged(table(spark, sf_dir, "documents")).select(*cols)


ORACLE = rf"""
with w as (
  select doc_id, source as host, row_number() over () as rid, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
  from documents),
win as (
  select rid, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) as x
  from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, x) as c from win) where c > 1),
cov as (select rid, count(distinct i + k) as n from rep, (values (0), (1), (2)) v(k) group by rid),
ln as (
  select rid, count(*) - count(distinct x) as n
  from (select rid, unnest(string_split(t, chr(10))) as x from w)
  where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid),
s as (
  select doc_id, host, len(ws)::bigint as n_words,
         length(regexp_replace(t, '{SPACES}', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(ln.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from w left join ln using (rid) left join cov using (rid)),
f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         10 * n_symbols > 3 * n_words as symbols_failed, 4 * n_dup_lines > n_words as lines_failed from s),
h as (
  select host, count(*) as n, sum(base_failed::int) as f1, sum(symbols_failed::int) as f2, sum(lines_failed::int) as f3
  from f where host is not null group by host),
m as (
  select avg(f1 / n) as m1, var_pop(f1 / n) as v1, avg(f2 / n) as m2, var_pop(f2 / n) as v2,
         avg(f3 / n) as m3, var_pop(f3 / n) as v3 from h),
p as (
  select *, case when v1 <= 1e-12 then 1000 else least(1000, greatest(1, m1 * (1 - m1) / v1 - 1)) end as s1,
         case when v2 <= 1e-12 then 1000 else least(1000, greatest(1, m2 * (1 - m2) / v2 - 1)) end as s2,
         case when v3 <= 1e-12 then 1000 else least(1000, greatest(1, m3 * (1 - m3) / v3 - 1)) end as s3 from m),
v as (
  select host, n as host_docs, f1::bigint as host_failed,
         (f1 + m1 * s1) / (n + s1) >= least(0.6, greatest(0.3, 3 * m1)) or (f2 + m2 * s2) / (n + s2) >= least(0.6, greatest(0.3, 3 * m2))
         or (f3 + m3 * s3) / (n + s3) >= least(0.6, greatest(0.3, 3 * m3)) as bad
  from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(bad, false) as kept, host, host_docs, host_failed,
       coalesce(bad, false) as host_rejected
from f left join v using (host)
"""

"""URL filter: rules first, else a ratio of two character Markov models.

A model of accepted and one of rejected URLs are exact counts of all contexts up to
``ORDER`` bytes, kept as a table that grows with the input: the bytes themselves are the key.
A character's score depends on the ``ORDER + 1`` bytes up to it alone, so distinct windows of
that width are scored once and joined with the URLs that have them. Each order's estimate is
smoothed towards the next lower one, so a context that was never seen leaves the shorter one in
force. Counts cover every URL that a rule decides, apart from a fifth by hash; on that fifth the
threshold of the mean log-likelihood difference per character is calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_text, prepare, stored, text_blocks

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts so.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 5
#: A window in more than one in this many places is hot.
HOT = 2000
#: Strength of the next lower order, and the alphabet of the lowest.
PRIOR, ALPHABET = 2.0, 256.0
#: Calibration bins over the log-likelihood difference per character.
BIN, SPAN = 0.01, 5.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = 2, 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and path; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES
            ) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url_no, window, times): the ``ORDER + 1`` bytes up to every character, as one number."""
    width = ORDER + 1
    for whole in batches:
        for batch in text_blocks(whole, "url", 1 << 18):
            flat, offsets = flat_text(batch.column("url"))
            sizes = np.diff(offsets)
            n, ends = len(sizes), np.cumsum(sizes + width)
            data = np.full(int(ends[-1]) if n else 0, _START, np.int64)
            data[ends - 1] = _END
            data[np.arange(flat.size) + np.repeat(np.arange(n) * width + ORDER, sizes)] = flat
            owner = np.repeat(np.arange(n), sizes + width)
            at = np.flatnonzero(np.arange(data.size) - (ends - sizes - width)[owner] >= ORDER)
            windows = np.zeros(at.size, np.int64)
            for back in range(ORDER, -1, -1):
                windows = windows << 8 | data[at - back]
            pairs, times = np.unique(np.stack([owner[at], windows], axis=1), axis=0,
                                     return_counts=True)
            numbers = batch.column("url_no").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[pairs[:, 0]]), pa.array(pairs[:, 1]), pa.array(times)],
                ["url_no", "window", "times"])


def window_scores(windows: DataFrame) -> DataFrame:
    """(window, rejected, accepted), once per window, to (window, score), exact at every order.

    ``score`` is the log-likelihood difference of the window's last character. The counts of an
    order are sums over the windows that end alike, grouped by key; orders 0 and 1 have at most
    65,536 keys and are broadcast.
    """
    found = windows.select("window")
    kinds = ("rejected", "accepted")
    for order in range(ORDER + 1):
        gram = F.col("window").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        grams_of = windows.groupBy(gram.alias(f"gram_{order}")).agg(
            *[F.sum(k).alias(f"{k}_gram_{order}") for k in kinds])
        before = F.shiftright(f"gram_{order}", 8)
        contexts = grams_of.groupBy(before.alias(f"context_{order}")).agg(
            *[F.sum(f"{k}_gram_{order}").alias(f"{k}_context_{order}") for k in kinds])
        if order < 2:
            grams_of, contexts = F.broadcast(grams_of), F.broadcast(contexts)
        found = (found.withColumn(f"gram_{order}", gram).join(grams_of, f"gram_{order}")
                 .withColumn(f"context_{order}", before).join(contexts, f"context_{order}"))
    logs = []
    for kind in kinds:
        p = F.lit(1 / ALPHABET)
        for order in range(ORDER + 1):
            p = ((F.col(f"{kind}_gram_{order}") + F.lit(PRIOR) * p)
                 / (F.col(f"{kind}_context_{order}") + F.lit(PRIOR)))
        logs.append(F.log(p))
    return found.select("window", (logs[1] - logs[0]).alias("score"))


def score_urls(urls: DataFrame) -> DataFrame:
    """(url_no, url, verdict, times, counted), once per URL, to (url_no, llr).

    The models count the URLs that are ``counted``, as often as they occur. Windows that hold
    more than one in ``HOT`` of all places, of which there are fewer than ``HOT``, are broadcast;
    the others are joined by key.
    """
    # a small checkpoint may be one partition: deal the URLs out before the heavy step
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = stored(urls.select("url_no", "url").repartition(tasks, "url_no").mapInArrow(
        _windows, "url_no long, window long, times long"))
    weights = urls.select("url_no", *[
        F.when(F.col("counted") & (F.col("verdict") == verdict), F.col("times")).otherwise(0)
        .alias(f"weight_{name}") for verdict, name in (("block", "rejected"), ("allow", "accepted"))])
    totals = stored(places.join(weights, "url_no").groupBy("window").agg(
        *[F.sum(F.col("times") * F.col(f"weight_{k}")).alias(k) for k in ("rejected", "accepted")],
        F.count("*").alias("n_places")))
    scores = stored(window_scores(totals.drop("n_places")))
    limit = totals.agg(F.sum("n_places") / HOT).scalar()
    hot = totals.filter(F.col("n_places") > limit).select("window").join(scores, "window")
    value = (F.sum(F.col("times") * F.col("score")).alias("total"), F.sum("times").alias("size"))
    common = places.join(F.broadcast(hot), "window").groupBy("url_no").agg(*value)
    other = (places.join(F.broadcast(hot.select("window")), "window", "left_anti")
             .join(scores, "window").groupBy("url_no").agg(*value))
    return common.unionByName(other).groupBy("url_no").agg(
        (F.sum("total") / F.sum("size")).alias("llr"))


def threshold(scored: DataFrame) -> float:
    """The threshold that separates the URLs of ``scored`` (llr, verdict, times).

    It maximises the mean of both classes' accuracies; without both classes it is 0.
    """
    bins = F.least(F.greatest(F.round(F.col("llr") / BIN), F.lit(-SPAN / BIN)),
                   F.lit(SPAN / BIN)).cast("int")
    found = scored.groupBy(bins.alias("bin"), "verdict").agg(F.sum("times").alias("count")).collect()
    tally: dict[int, list[int]] = {}
    for row in found:
        tally.setdefault(row.bin, [0, 0])[row.verdict == "allow"] += row["count"]
    blocked, allowed = (sum(t[k] for t in tally.values()) for k in (0, 1))
    if not blocked or not allowed:
        return 0.0
    best, cut, below = -1.0, 0.0, [0, 0]
    steps = sorted(tally)
    for i, step in enumerate(steps[:-1]):
        below = [a + b for a, b in zip(below, tally[step], strict=True)]
        merit = below[0] / blocked + (allowed - below[1]) / allowed
        if merit > best:
            best, cut = merit, (step + steps[i + 1]) / 2 * BIN
    return cut


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, llr, threshold.

    The longest rule that fits decides; without one, ``llr`` (mean log-likelihood difference
    per character) is held against ``threshold``, from which on a URL is allowed. A null URL
    or one without ``://`` has empty host and path, no rule, and a null one scores 0; rules of
    equal length do not fit the same URL. Very long URLs are read whole. Repeated rows give
    repeated rows, an empty table gives an empty result, further columns are ignored.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("*", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    fifth = F.pmod(F.xxhash64("url", F.lit("calibrate")), F.lit(5)) == 0
    urls = stored(rows.filter("url is not null").groupBy("url").agg(
        F.first("verdict").alias("verdict"), F.count("*").alias("times"))
        .select("*", F.monotonically_increasing_id().alias("url_no"),
                (F.col("verdict").isNotNull() & ~fifth).alias("counted")))
    scored = stored(urls.join(score_urls(urls), "url_no").select(
        "url", "llr", "verdict", "times", fifth.alias("held")))
    cut = threshold(scored.filter("held and verdict is not null"))
    # null URLs meet nothing; a salt keeps them from meeting in one task
    salt = F.when(F.col("url").isNull(), F.monotonically_increasing_id() % 4096).otherwise(0)
    found = scored.select("url", "llr", F.lit(0).cast("long").alias("salt"))
    judged = rows.withColumn("salt", salt.cast("long")).join(found, ["url", "salt"], "left").withColumn(
        "llr", F.coalesce("llr", F.lit(0.0)))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("llr") >= cut, "allow").otherwise("block")).alias("verdict"),
        "llr", F.lit(cut).alias("threshold"))

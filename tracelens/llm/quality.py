"""Quality rules with risk-controlled thresholds.

Every rule rejects a document whose value lies above a cutoff. A labelled holdout picks the cutoffs of each stratum in two
walks from lenient to strict. In the joint walk one rule tightens at a time, and an exact binomial test asks of each step whether
the share of good documents that any rule rejects is at most ``risk``; the first failure ends it (fixed-sequence testing). The
other walk takes each rule by itself with an equal share of the risk: it needs many labels, but a rule that fails leaves the
others alone. The walk that comes further counts. A Bonferroni split over strata, walks and rules keeps the family-wise error,
so both walks hold at once and the choice costs nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialize, utf8

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Continuation bytes of UTF-8 and white space: what remains without them is one byte for each code point in words.
_NOT_WORD = bytes(range(0x80, 0xC0)) + SPACES
_UPPER = bytes(range(65, 91))

FEATURES = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "n_lines:bigint,n_upper:bigint,n_bangs:bigint>"
)

NAMES = tuple(x.split(":")[0] for x in FEATURES[7:-1].split(","))

#: Rule: (value as SQL over the features, cutoffs from lenient to strict).
RULES = {
    "symbols_per_char": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03]),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "upper_share": ("n_upper / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "bangs_per_word": ("n_bangs / greatest(n_words, 1)", [2, 1.5, 1, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05]),
    "word_length": ("word_chars / greatest(n_words, 1)", [40, 30, 25, 20, 16, 14, 12, 11, 10, 9]),
    "short_words": ("-(word_chars / greatest(n_words, 1))", [-1.5, -2, -2.5, -3, -3.5, -4]),
    "few_words": ("-n_words", [-2, -5, -10, -20, -30, -40, -50, -60]),
}

#: Rules that the joint walk tightens after all others: the base rules reject below 50 words whatever the cutoff.
LAST = frozenset({"few_words"})
#: Key of the joint walk among the rules' counts.
JOINT = ""


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text holds twice or more."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    seen: set = set()
    twice = {g for g in grams if g in seen or seen.add(g)}
    total, upto = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measure(text: bytes) -> tuple[int, ...]:
    """The features of one text, in the order of ``FEATURES``."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    without = lambda drop: len(text) - len(text.translate(None, drop))
    return (
        len(words), len(text.translate(None, _NOT_WORD)), without(SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), without(_UPPER), without(b"!"),
    )


def features(text: str) -> Column:
    """Column of ``FEATURES`` of a text column."""

    @F.arrow_udf(FEATURES)
    def run(column: pa.Array) -> pa.Array:
        rows = [measure(x) for x in utf8(column)]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(NAMES))], names=list(NAMES))

    return run(text)


def tail(n: int, k: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed: the p-value of k false rejections of n against a risk of p or more."""
    if n == 0 or k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(cutoffs: list[float], beyond: list[int], n: int, risk: float, level: float) -> float | None:
    """The strictest cutoff that fixed-sequence testing reaches; None where not even the first passes.

    ``beyond[i]``: how many of n good documents lie above cutoffs[i].
    """
    best = None
    for cutoff, k in zip(cutoffs, beyond):
        if k > risk * n or tail(n, k, risk) > level:
            break
        best = float(cutoff)
    return best


def stratum_of(column: str | None) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")


def joint_steps(rules: dict) -> list[tuple[str, int]]:
    """(rule, index of its cutoff) in the order of the joint walk: all rules come through their cutoffs at the same pace."""
    steps = [(name, i) for name, (_, cutoffs) in rules.items() for i in range(len(cutoffs))]
    return sorted(steps, key=lambda s: (s[0] in LAST, (s[1] + 1) / len(rules[s[0]][1])))


def cutoffs_of(firsts: dict, rules: dict, risk: float, level: float) -> dict[str, float]:
    """Cutoffs of one stratum. ``firsts``: by rule, or JOINT, how many good documents are first rejected at which cutoff or step (at None: never)."""
    n, steps = sum(firsts[JOINT].values()), joint_steps(rules)

    def walk(name: str, size: int, share: float, part: float) -> int:
        """Number of cutoffs or steps that pass."""
        beyond = [sum(k for at, k in firsts[name].items() if at is not None and at <= i) for i in range(size)]
        last = choose(list(range(size)), beyond, n, share, part)
        return 0 if last is None else int(last) + 1

    joint = {rule: i + 1 for rule, i in steps[: walk(JOINT, len(steps), risk, level / 2)]}
    each = {rule: walk(rule, len(cutoffs), risk / len(rules), level / (2 * len(rules))) for rule, (_, cutoffs) in rules.items()}
    best = max(joint, each, key=lambda found: sum(k / len(rules[rule][1]) for rule, k in found.items()))
    return {rule: float(rules[rule][1][k - 1]) for rule, k in best.items() if k}


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the good documents: those whose labels are all quality 1."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1 and doc_id is not null").select("doc_id")


#: Bits of the table by which rows without a good label are told apart before they are measured; it never grows.
SIEVE_BITS = 1 << 23


def sieve(ids: DataFrame) -> np.ndarray:
    """Table of SIEVE_BITS bits, those of the ids set; at most SIEVE_BITS / 64 words reach the driver, however many ids there are."""
    slots = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS)).alias("slot"))
    words = slots.selectExpr("cast(slot div 64 as int) as word", "shiftleft(1L, cast(slot % 64 as int)) as bit")
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def measure_good(docs: DataFrame, good: DataFrame, stratum: str | None) -> DataFrame:
    """doc_id, stratum, version (a hash of the text) and features q of the documents that have a good label, and of some others: the sieve lets a
    share of them pass, which ``calibrate``'s join drops. Other texts are not measured."""
    bits = docs.sparkSession.sparkContext.broadcast(sieve(good).view(np.uint64))
    rows = docs.select("doc_id", stratum_of(stratum).alias("stratum"), F.xxhash64("text").alias("version"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS)).alias("slot"))
    kinds = pa.struct([(n, pa.int64()) for n in NAMES])

    def run(batches):
        for batch in batches:
            slot = batch["slot"].to_numpy(zero_copy_only=False)
            hit = (bits.value[slot // 64] >> (slot % 64).astype(np.uint64)) & np.uint64(1)
            own = batch.filter(pa.array(hit.astype(bool)))
            q = [dict(zip(NAMES, measure(x))) for x in utf8(own["text"])]
            yield pa.RecordBatch.from_arrays([own["doc_id"], own["stratum"], own["version"], pa.array(q, kinds)], names=["doc_id", "stratum", "version", "q"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stratum string, version long, q {FEATURES}")


def trials(held: DataFrame) -> DataFrame:
    """stratum and features of one trial for each doc_id and each distinct text of a stratum, from rows (doc_id, stratum, version, q).

    Rows that repeat a document, and copies of its text under other ids, say nothing new, and the binomial bound is about independent trials. Of equal
    texts the smallest doc_id counts, of several texts of one doc_id that with the smallest hash.
    """
    texts = held.groupBy("stratum", "version").agg(F.min("doc_id").alias("doc_id"), F.min("q").alias("q"))
    return texts.groupBy("stratum", "doc_id").agg(F.min(F.struct("version", "q")).alias("one")).select("stratum", "one.q.*")


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05, rules: dict = RULES) -> DataFrame:
    """(stratum, cutoffs map<string,double>): a rule that no cutoff passes for is left out of the map, a stratum without cutoffs has no row.

    ``measured``: doc_id, stratum, version, q (features) of the good documents at least (``good_ids``); see ``trials`` for what counts.
    """
    held = trials(measured.join(good_ids(labels), "doc_id", "left_semi"))
    # cutoffs fall, so the first that a value lies above is found by how many do not lie below it
    first = {
        name: F.expr(f"nullif(size(filter(array({', '.join(f'{float(c)}D' for c in cutoffs)}), c -> double({value}) <= c)), {len(cutoffs)})")
        for name, (value, cutoffs) in rules.items()
    }
    at = {step: n for n, step in enumerate(joint_steps(rules))}
    step_of = lambda name: F.get(F.array(*[F.lit(at[name, i]) for i in range(len(rules[name][1]))]), F.col(f"__{name}"))
    found = [F.struct(F.lit(name).alias("rule"), F.col(f"__{name}").alias("at")) for name in rules]
    found.append(F.struct(F.lit(JOINT).alias("rule"), F.array_min(F.array(*[step_of(name) for name in rules])).alias("at")))
    counts = (
        held.select("stratum", *[c.alias(f"__{name}") for name, c in first.items()]).select("stratum", F.explode(F.array(*found)).alias("r"))
        .groupBy("stratum", "r.rule", "r.at").count().groupBy("stratum").agg(F.collect_list(F.struct("rule", "at", "count")).alias("counts"))
    )
    strata = max(1, counts.count())

    @F.arrow_udf("map<string,double>")
    def chosen(column: pa.Array) -> pa.Array:
        out = []
        for rows in column.to_pylist():
            firsts: dict = {name: {} for name in (*rules, JOINT)}
            for r in rows:
                firsts[r["rule"]][r["at"]] = r["count"]
            out.append(list(cutoffs_of(firsts, rules, risk, level / strata).items()))
        return pa.array(out, pa.map_(pa.string(), pa.float64()))

    return counts.select("stratum", chosen("counts").alias("cutoffs")).filter(F.size("cutoffs") > 0)


#: Greatest number of strata whose cutoffs are broadcast.
BROADCAST_ROWS = 10_000


def with_cutoffs(rows: DataFrame, stratum: str, cutoffs: DataFrame) -> DataFrame:
    """Adds __cutoffs of each row's stratum. The cutoffs, a row for each stratum, are broadcast up to BROADCAST_ROWS rows."""
    if cutoffs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        cutoffs = F.broadcast(cutoffs)
    return rows.join(cutoffs.select(F.col("stratum").alias("__of"), F.col("cutoffs").alias("__cutoffs")), F.col(stratum) == F.col("__of"), "left").drop("__of")


def verdict(q: str, rules: dict = RULES) -> tuple[Column, Column]:
    """(whether the base rules reject, names of the rules that do) from features ``q`` and __cutoffs."""
    failed = [F.when(F.expr(value_of(value, q)) > F.coalesce(F.col("__cutoffs")[name], F.lit(math.inf)), F.lit(name)) for name, (value, _) in rules.items()]
    base = (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))
    return base, F.array_compact(F.array(*failed))


def value_of(value: str, q: str) -> str:
    """A rule's SQL over the fields of ``q``."""
    names = sorted(NAMES, key=len, reverse=True)
    for i, n in enumerate(names):
        value = value.replace(n, f"@{i}@")
    for i, n in enumerate(names):
        value = value.replace(f"@{i}@", f"{q}.{n}")
    return f"double({value})"


def assess(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, stratum, q (features), base_failed, failed_rules, kept. All rows are measured once.

    Null and empty texts have no words and fail. A null stratum is a stratum of its own (''). Labels of a document
    that disagree count as not good; labels with null quality or unknown doc_id count for nothing. Without labels no
    cutoff is set, and only the base rules reject. Repeated rows each give a row. Only doc_id, text and the stratum are read.
    """
    measured = materialize(docs.select("doc_id", stratum_of(stratum).alias("stratum"), F.xxhash64("text").alias("version"), features("text").alias("q")), "quality")
    base, failed = verdict("q", options.get("rules") or RULES)
    judged = with_cutoffs(measured, "stratum", materialize(calibrate(measured, labels, **options), "cutoffs"))
    judged = judged.select("doc_id", "stratum", "q", base.alias("base_failed"), failed.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their columns.

    The cutoffs come from a first pass that measures labelled documents alone; the second pass judges each row where it lies, so texts are
    never shuffled. Null and empty texts go (no words), repeated rows stay or go together, an empty table stays empty. Where the strata are
    more than BROADCAST_ROWS, columns named __stratum and __q are taken for this operator's own; otherwise no name is.
    """
    rules = options.get("rules") or RULES
    measured = materialize(measure_good(docs, materialize(good_ids(labels), "good"), stratum), "quality")
    cutoffs = materialize(calibrate(measured, labels, **options), "cutoffs")
    if cutoffs.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        base, failed = verdict("__q", rules)
        whole = with_cutoffs(docs.withColumns({"__stratum": stratum_of(stratum), "__q": features("text")}), "__stratum", cutoffs)
        return whole.filter(~base & (F.size(failed) == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast({r["stratum"]: r["cutoffs"] for r in cutoffs.collect()})
    formulas = {rule: compile(value.replace("greatest", "maximum"), rule, "eval") for rule, (value, _) in rules.items()}

    def make():
        def judge(batch: pa.RecordBatch) -> list[bool]:
            """All rows of a batch at once: features as arrays, rules over arrays."""
            if not batch.num_rows:
                return []
            q = dict(zip(NAMES, np.array([measure(x) for x in utf8(batch["text"])], np.int64).T))
            good = (q["n_words"] >= 50) & (100 * q["n_repeat_words"] <= 50 * q["n_words"])
            strata = [s or "" for s in batch[stratum].cast(pa.string()).to_pylist()] if stratum else [""] * batch.num_rows
            for rule, formula in formulas.items():
                limit = np.array([shared.value.get(s, {}).get(rule, math.inf) for s in strata])
                good &= ~(eval(formula, {"maximum": np.maximum}, q) > limit)
            return good.tolist()

        return judge

    return keep_rows(docs, make)


def digest(assessed: DataFrame) -> DataFrame:
    """The contract's columns from ``assess``' result, and the names of the learned rules that reject, comma-joined."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return assessed.select("doc_id", *[f"q.{n}" for n in names], "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))

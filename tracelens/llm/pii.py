"""Personal data, found with DataFrame functions alone.

Regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm them, and context words in the characters
before and after a span raise or lower its score; what reaches the threshold stays. All steps take time in proportion to a text's length
and number of spans: running offsets are folded in chunks (``scan``), and no part of a text is cut out by counting from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of listing; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: Patterns of the base kinds. They find what the plain patterns of the contract find, leftmost and non-overlapping, in linear
#: time: a match of a greedy run starts at the run's first character or where the last match ended, and no run gives back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Patterns of the method's own spans: cards beside other digits, local phone numbers, IBANs, social security numbers.
MORE = {
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7})(?![0-9])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Characters without which a kind can't occur, as a cheap test before its pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Score of a confirmed span, words near it that raise the score, and words near it that lower it.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.6, "phone": 0.3, "iban": 0.6, "ssn": 0.3}
CONTEXT = {
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|fax|mobile|cell|telefon|appel|llamar",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "email": "mail|email|contact", "ip": "ip|address|host|server",
}
AGAINST = "order|invoice|part|serial|sku|isbn|issn|tracking|version|ticket|example"
RAISE, LOWER, BEFORE, AFTER, THRESHOLD = 0.3, 0.2, 48, 24, 0.6

_SPAN = "array<struct<start:bigint,end:bigint,near:string>>"
_PAIR = "array<struct<m:string,g:string,at:bigint,n:bigint,ok:boolean>>"
CHUNK, PIECE = 256, 2048


def scan(items: str, combine, value, emit, kind: str) -> str:
    """SQL of a fold that gives an array: ``emit(p, i, at, x)`` is an array for each element x of ``items``, at index i (from 0) of the whole array p,
    and ``at`` is ``combine`` over the ``value`` of all elements before.

    ``combine`` is associative with 0 as its start (a sum, or a greatest). Arrays grow within chunks of CHUNK elements only, whose starts come from a
    fold over the chunks' totals, so the time is in proportion to the elements.
    """
    part = f"slice(p, c * {CHUNK} + 1, {CHUNK})"
    chunks = f"sequence(0, greatest(size(p) - 1, 0) div {CHUNK})"
    totals = f"transform({chunks}, c -> aggregate({part}, 0L, (s, x) -> {combine('s', value('x'))}))"
    starts = f"aggregate(t, array(0L), (s, v) -> concat(s, array({combine('element_at(s, -1)', 'v')})))"
    step = f"(s, x) -> named_struct('at', {combine('s.at', value('x'))}, 'i', s.i + 1, 'out', concat(s.out, {emit('p', 's.i', 's.at', 'x')}))"
    folded = f"flatten(transform({chunks}, c -> aggregate({part}, named_struct('at', o[c], 'i', c * {CHUNK}, 'out', cast(array() as {kind})), {step}, s -> s.out)))"
    return f"transform(array({items}), p -> transform(array({totals}), t -> transform(array({starts}), o -> {folded})[0])[0])[0]"


def pairs_of(text: str, pattern: str, kind: str) -> Column:
    """Array of a pattern's matches m with the text g before each, their lengths, and whether the match is confirmed; a last element holds the rest (m null)."""
    p = pattern.replace("\\", "\\\\")
    ok = f"case when m is null then false else coalesce({confirmed(kind, 'm')}, false) end"
    return F.expr(
        f"zip_with(regexp_extract_all({text}, '{p}', 0), split({text}, '{p}', -1), "
        f"(m, g) -> named_struct('m', m, 'g', g, 'at', length(g) + 0L, 'n', coalesce(length(m), 0) + 0L, 'ok', {ok}))"
    )


def spans_of(pairs: str) -> Column:
    """Array of (start, end, near) of the confirmed matches; offsets in code points. near: up to BEFORE characters before a span, '|', and what follows
    it up to the next match, AFTER characters at most, in lower case."""
    def emit(p, i, at, x):
        behind = f"if({x}.at >= {BEFORE}, right({x}.g, {BEFORE}), right(concat(array_join(transform(slice({p}, greatest({i} - {BEFORE - 1}, 1), least({i}, {BEFORE})), y -> concat(right(y.g, {BEFORE}), y.m)), ''), {x}.g), {BEFORE}))"
        near = f"lower(concat({behind}, '|', left(coalesce(get({p}, {i} + 1).g, ''), {AFTER})))"
        return f"if({x}.ok, array(named_struct('start', {at} + {x}.at, 'end', {at} + {x}.at + {x}.n, 'near', {near})), cast(array() as {_SPAN}))"

    return F.expr(scan(pairs, lambda a, b: f"{a} + {b}", lambda x: f"{x}.at + {x}.n", emit, _SPAN))


def masked(text: str, pairs: str) -> Column:
    """The text with confirmed matches overwritten by NUL, character by character."""
    return F.expr(f"if(exists({pairs}, x -> x.ok), array_join(transform({pairs}, x -> concat(x.g, if(x.ok, repeat(chr(0), cast(x.n as int)), coalesce(x.m, '')))), ''), {text})")


def confirmed(kind: str, x: str) -> str:
    """SQL of whether a match is one of its kind: parts of an address at most 255, Luhn, digits of a phone number, remainder modulo 97."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return f"{x} rlike '^{part}(?:[.]{part}){{3}}$'"
    if kind == "card":
        return f"case when length({x}) >= 12 and length({digits}) between 12 and 19 then luhn_check({digits}) else false end"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    if kind == "iban":  # four characters move to the end, letters read as 10 to 35
        plain = f"replace({x}, ' ', '')"
        step = "(r, c) -> if(c between '0' and '9', (r * 10 + ascii(c) - 48) % 97, if(c between 'A' and 'Z', (r * 100 + ascii(c) - 55) % 97, r))"
        return f"aggregate(split(concat(substring({plain}, 5, 40), substring({plain}, 1, 4)), ''), 0, {step}) = 1"
    return "true"


def with_score(kind: str, spans: Column, base: bool) -> Column:
    """(start, order, end, kind, score, base) of spans; a base span keeps the threshold at least."""
    order = KINDS.index(kind)

    def one(s):
        score = F.lit(SCORES[kind]) + F.when(s["near"].rlike(rf"\b(?:{CONTEXT[kind]})\b"), RAISE).otherwise(0.0) - F.when(s["near"].rlike(rf"\b(?:{AGAINST})\b"), LOWER).otherwise(0.0)
        score = F.least(F.greatest(score, F.lit(THRESHOLD)) if base else score, F.lit(1.0))
        return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"), F.lit(base).alias("base"))

    return F.transform(spans, one)


def find(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with a last column ``out``: array of (start, order, end, kind, score, base) by start, then kind as listed.

    Offsets are code points, end exclusive. All base spans are there; the method looks for its own spans of a base kind in the text without
    the base spans of that kind, so those never overlap. Null and empty texts have none. A column ``out`` that ``docs`` has already is replaced;
    columns whose names begin with __pii_ are taken for this operator's own. Rows stay one to one.
    """
    from functools import reduce

    none = lambda kind: F.expr(f"cast(array() as {kind})")
    work = docs.withColumn("__pii_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    work = work.withColumn("__pii_digits", F.col("__pii_text").rlike("[0-9]"))
    need = {k: F.col("__pii_text").contains(NEEDS[k]) if k in NEEDS else F.col("__pii_digits") for k in BASE}
    work = work.withColumns({f"__pii_{k}": F.when(need[k], pairs_of("__pii_text", BASE[k], k)).otherwise(none(_PAIR)) for k in BASE})
    work = work.withColumns({f"__pii_free_{k}": masked("__pii_text", f"__pii_{k}") for k in BASE if k in MORE})
    work = work.withColumns({f"__pii_more_{k}": F.when(F.col("__pii_digits"), pairs_of(f"__pii_free_{k}" if k in BASE else "__pii_text", MORE[k], k)).otherwise(none(_PAIR)) for k in MORE})
    found = lambda pairs: F.when(F.exists(pairs, lambda x: x["ok"]), spans_of(pairs)).otherwise(none(_SPAN))
    parts = [with_score(k, found(f"__pii_{k}"), True) for k in BASE]
    parts += [F.filter(with_score(k, found(f"__pii_more_{k}"), False), lambda s: s["score"] >= THRESHOLD - 1e-9) for k in MORE]
    work = work.withColumn(out, F.array_sort(reduce(lambda a, b: F.concat(a, b), parts)))
    return work.drop(*[c for c in work.columns if c.startswith("__pii_") and c != out])


def redacted(text: str = "text", spans: str = "pii_spans") -> Column:
    """The text with every stretch of overlapping spans replaced by the first one's kind in brackets; null stays null.

    The text is cut into pieces of PIECE characters once; what lies between two stretches is taken from the pieces that hold it.
    """
    def between(a: str, b: str) -> str:
        held = f"array_join(slice(q, cast({a} div {PIECE} as int) + 1, cast(({b} - 1) div {PIECE} - {a} div {PIECE} as int) + 1), '')"
        return f"if({b} <= {a}, '', substring({held}, cast({a} % {PIECE} as int) + 1, cast({b} - {a} as int)))"

    def emit(p, i, at, s):
        return f"if({s}.start < {at} or {s}.end <= {at}, cast(array() as array<string>), array({between(at, s + '.start')}, concat('[', upper({s}.kind), ']')))"

    greatest = lambda a, b: f"greatest({a}, {b})"
    body = scan(spans, greatest, lambda x: f"{x}.end", emit, "array<string>")
    last = f"array_max({spans}.end)"
    whole = f"transform(array(regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)), q -> concat(array_join({body}, ''), {between(last, f'(length({text}) + 0L)')}))[0]"
    return F.expr(f"case when size({spans}) = 0 then {text} else {whole} end")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by its kind in brackets and n_chars counted anew; columns and rows as before.

    A null text stays null, with a null n_chars; an empty one stays empty. Repeated rows are worked off each by itself.
    """
    out = find(docs, out="__pii_spans").withColumn("text", redacted(spans="__pii_spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``'s result."""
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii_spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii_spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(join(base).cast("binary"), 256).alias("base_sha256"),
        join(F.col("pii_spans")).alias("spans"),
    )

"""Personal data against a plain statement of the base rules."""

import hashlib
import random
import re

from tracelens.llm import pii as P


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def texts():
    rng = random.Random(5)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "_", "@", ".", " ", "-", "\n", "é", "😀", "4465758382889437", "4465 7583 8288 9437",
            "+1 (555) 555-1234", "+49", "255.255.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.4", "12", "7", "phone ", "iban ",
            "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "card ", "(555) 555-0199", "[", "]"]
    made = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(300)]
    return made + ["", None, "1" * 20000, "a" * 50000, "1 " * 10000, "a@" * 5000, "1." * 5000, "+1" + "(" * 5000 + "2", "x@y.z " * 400]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "e", 3) for i, t in rows], "doc_id long, text string, kind string, start int")
    got = {r.doc_id: r for r in P.digest(P.find(docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t, joined, got[i].spans)
        assert [got[i][f"n_{k}"] for k in P.BASE] == [sum(x[3] == k for x in want) for k in P.BASE]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert not set(joined.split(",") if joined else []) - set(spans)


def test_method_spans(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789"),
            (5, "call (555) 555-0199"), (6, "4465758382889437 4465758382889437"), (7, None)]
    got = {r.doc_id: r.spans for r in P.digest(P.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: "", 5: "phone:5:19", 6: "card:0:16,card:17:33", 7: ""}


def test_redact(spark):
    rows = [(1, "mail é a@b.c, +1 (555) 555-1234!", 3), (2, None, 0), (3, "clean", 5), (4, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: tuple(r)[1:] for r in P.redact(docs).collect()}
    assert got == {1: ("mail é [EMAIL], [PHONE]!", 24), 2: (None, None), 3: ("clean", 5), 4: ("", 0)}


def test_native(spark):
    plan = P.digest(P.find(spark.createDataFrame([(1, "x")], "doc_id long, text string")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert P.digest(P.find(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def own(text, taken):
    """The method's own spans of a text by plain steps: (start, end, kind)."""
    out = []
    for kind, pattern in P.MORE.items():
        hidden = list(text)
        for a, _, e, k in taken:
            if k == kind:
                hidden[a:e] = "\0" * (e - a)
        found = list(re.finditer(pattern, "".join(hidden)))
        for i, m in enumerate(found):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "iban":
                plain = m[0].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
                    continue
            after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)][: P.AFTER]
            near = f"{''.join(hidden)[max(0, m.start() - P.BEFORE) : m.start()]}|{after}".lower()
            score = P.SCORES[kind] + P.RAISE * bool(re.search(rf"\b(?:{P.CONTEXT[kind]})\b", near)) - P.LOWER * bool(re.search(rf"\b(?:{P.AGAINST})\b", near))
            if score > P.THRESHOLD - 1e-6:
                out.append((m.start(), m.end(), kind))
    return out


def test_all_spans_and_redaction_against_plain_steps(spark):
    rng = random.Random(11)
    bits = ["4465758382889437", "4465 7583 8288 9437", " ", ", ", "phone ", "555-555-0199", "(555) 555-0199", "ssn ", "123-45-6789", "order ", "card", "GB82 WEST 1234 5698 7654 32", "iban ", "+1 (555) 555-1234",
            "a@b.co", "x" * 30, "\n", "é😀", "7", " visa", "10.0.0.1", "invoice no "]
    made = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)] + ["call 555-555-0199 or " * 700, "", None, "é😀x" * 3000 + "a@b.co"]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(made)], "doc_id long, text string, n_chars long").repartition(4)
    spans = {r.doc_id: r.spans.split(",") if r.spans else [] for r in P.digest(P.find(docs)).collect()}
    plain = {r.doc_id: r.text for r in P.redact(docs).collect()}
    some = set()
    for i, t in enumerate(made):
        taken = base(t or "")
        want = sorted([(a, e, k) for a, _, e, k in taken] + own(t or "", taken), key=lambda s: (s[0], P.KINDS.index(s[2]), s[1]))
        assert spans[i] == [f"{k}:{a}:{e}" for a, e, k in want], t
        some |= {k for a, e, k in want if (a, P.KINDS.index(k), e, k) not in taken}
        text, at = "", 0
        for a, e, k in want:
            if a >= at:
                text += t[at:a] + f"[{k.upper()}]"
            at = max(at, e)
        assert plain[i] == (None if t is None else text + t[at:])
    assert some == set(P.MORE)


def test_time_in_proportion(spark):
    import time

    times = []
    for n in (5_000, 5_000, 20_000):
        docs = spark.createDataFrame([(1, "".join(f"user{i % 90}@mail.example.com +1 (555) 555-{i % 9000 + 1000} " for i in range(n)), 0)], "doc_id long, text string, n_chars long")
        start = time.perf_counter()
        r = P.digest(P.find(docs)).head()
        text = P.redact(docs).head().text
        times.append(time.perf_counter() - start)
        assert r.n_email == r.n_phone == n and text == "[EMAIL] [PHONE] " * n
    assert times[2] < 10 * times[1] + 2  # four times the text

"""Personal data: patterns propose, checksums confirm, context scores.

Regular expressions propose spans.  Validators (value ranges, digit counts,
Luhn, mod-97, mixed characters) confirm or drop them.  Every span has a
score: that of its kind, raised by words of the kind close by on either
side and lowered by words that speak against it.  The four base kinds stay
whatever their score; spans of the added kinds go if it is under
``THRESHOLD``, so a kind whose pattern proves little needs a word nearby.

Positions come from the gaps between matches: splitting by a pattern and
extracting it walk the same leftmost matches, so the lengths of the pieces
add up to every match's place, in one native pass without a UDF.  The sums
run over blocks of pieces, so a text with very many matches costs what its
length costs, and not the square of it.

The patterns are rewritten with possessive quantifiers and look-behind so
that no run of characters is scanned twice; they match what the plain
forms match.

Defined cases: null text counts as empty; an empty text has no spans and
the digest of the empty string; repeated rows each get their own result;
words of context are looked for within ``CONTEXT_CHARS`` characters, over
at most ``REACH`` other spans of the kind; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.textcols import text_of


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that any text with a match passes.
    hint: str
    #: The score without context.
    score: float
    #: Words close by that raise the score by RAISE, and that lower it by it.
    words: str = ""
    against: str = ""


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, r"e-?mail|contact|write|reach", r"example|noreply|no-reply"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.5, r"\bip\b|address|host|server|client|login", r"version|release|\bv\b|section|chapter"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9][0-9\x20-]{12}", 0.6, r"card|visa|master|amex|credit|debit|payment|cvv|expir", r"order|serial|tracking|isbn|invoice"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"phone|mobile|cell|call|tel\b|fax|whatsapp|dial", r"version|total|score"),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", 0.8, r"iban|account|bank|konto|compte|cuenta", r"serial|licen[cs]e"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"\bssns?\b|social security|tax\s?(?:id|payer)|\bitin\b", r"part|order|invoice|phone"),
    Kind(
        "secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}", r"(?i)token|secret|passw|pwd|passphrase|key|bearer|auth|credential|akia|gh[pousr]_|xox[abprs]-|sk-|eyj", 0.3,
        r"token|secret|passw(?:or)?d|pwd|passphrase|api[_\s-]?key|access[_\s-]?key|private[_\s-]?key|bearer|authori[sz]ation|credentials?", r"checksum|sha-?(?:1|256)|md5|commit|digest",
    ),
)
#: Secrets whose form alone tells: cloud keys, personal tokens, chat tokens, signed web tokens.
KNOWN_SECRET = r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,})"
CONTEXT_CHARS = 40
REACH = 3
THRESHOLD = 0.5
RAISE = 0.3
BLOCK = 256
SPAN = "struct<start:int,end:int,match:string,near:string>"


def pieces(text: Column, kind: Kind) -> Column:
    """Array of (gap, match): what lies before each match, and the match;
    the last has no match."""
    found, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    hinted = F.contains(text, F.lit(kind.hint)) if len(kind.hint) == 1 else text.rlike(kind.hint)
    both = F.zip_with(gaps, F.slice(found, 1, F.size(gaps)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(hinted, both).otherwise(F.expr("cast(array() as array<struct<gap:string,match:string>>)"))


def placed(rows: DataFrame, kind: Kind) -> DataFrame:
    """Adds column ``kind.name``: array of (start, end, match, near), the
    leftmost matches in order.

    A running sum inside one aggregate would copy the array that it builds
    at every step.  So lengths are summed for blocks of pieces, the blocks'
    starts are summed up, and each block builds a short array from there.
    """
    p, s, out = f"_{kind.name}_p", f"_{kind.name}_s", kind.name
    rows = rows.withColumn(p, pieces(F.col("t"), kind))
    block = lambda b: F.slice(F.col(p), b * BLOCK + 1, F.lit(BLOCK))
    blocks = F.when(F.size(p) > 1, F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))))
    none = F.array().cast("array<int>")
    rows = rows.withColumn(s, sums)
    starts = F.aggregate(F.col(s), F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    rows = rows.withColumn(s, starts)

    def near(i: Column) -> Column:
        """The words around the match of piece ``i``."""
        part = lambda k, name, f: F.coalesce(f(F.get(F.col(p), i + k)[name], F.lit(CONTEXT_CHARS)), F.lit(""))
        before = [part(k, name, F.right) for k in range(-REACH, 1) for name in ("gap", "match") if (k, name) != (0, "match")]
        after = [part(k, name, F.left) for k in range(1, REACH + 1) for name in ("gap", "match")]
        return F.lower(F.concat_ws(" ", F.right(F.concat(*before), F.lit(CONTEXT_CHARS)), F.left(F.concat(*after), F.lit(CONTEXT_CHARS))))

    def fill(start: Column, b: Column) -> Column:
        def step(a, x):
            begin = a["at"] + F.length(x["gap"])
            end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
            span = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"), near(a["i"]).alias("near"))
            return F.struct((a["i"] + 1).alias("i"), end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        seed = F.struct((b * BLOCK).alias("i"), start.alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))
        return F.aggregate(block(b), seed, step, lambda a: a["out"])

    numbered = F.transform(F.col(s), lambda start, b: fill(start, b))
    return rows.withColumn(out, F.filter(F.flatten(numbered), lambda x: x["match"].isNotNull())).drop(p, s)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn over up to 19 digits; zeros on the left change nothing."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(1, 20):
        d = F.substring(padded, i, 1).cast("int")
        total = total + (d if i % 2 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """ISO 7064 mod 97-10 of an account code: the first four characters go
    last, letters become 10-35, and the number leaves 1."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, "", -1), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(F.when(value(c) > 9, (r * 100 + value(c)) % 97).otherwise((r * 10 + value(c)) % 97))) == 1


def confirmed(kind: Kind, m: Column) -> Column:
    """The kind's own validator."""
    if kind.name == "ip":
        return F.forall(F.split(m, r"\.", -1), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind.name == "card":
        return F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    if kind.name == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind.name == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    if kind.name == "ssn":
        return ~m.rlike("^(?:000|666|9[0-9]{2})-|-00-|-0000$")
    if kind.name == "secret":
        mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, "", -1))) >= 8)
        return m.rlike(KNOWN_SECRET) | mixed
    return F.lit(True)


def scored(kind: Kind, span: Column) -> Column:
    """The span's score, from 0 to 1."""
    known = F.when(span["match"].rlike(KNOWN_SECRET), F.lit(0.9)).otherwise(F.lit(kind.score)) if kind.name == "secret" else F.lit(kind.score)
    up = F.when(span["near"].rlike(kind.words), F.lit(RAISE)).otherwise(F.lit(0.0))
    down = F.when(span["near"].rlike(kind.against), F.lit(RAISE)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), known + up - down)), 2)


def spans(docs: DataFrame, text: str = "text", kinds=BASE + ADDED) -> DataFrame:
    """doc (the row) and one array of (start, end, match, score) for each kind."""
    found = docs.select(F.struct("*").alias("doc"), text_of(text).alias("t"))
    for kind in kinds:
        found = placed(found, kind)
        own = F.transform(F.filter(kind.name, lambda x: confirmed(kind, x["match"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), scored(kind, x).alias("score")))
        found = found.withColumn(kind.name, own if kind in BASE else F.filter(own, lambda x: x["score"] >= THRESHOLD))
    return found.select("doc", *[k.name for k in kinds])


def listed(kinds, score: bool = False) -> Column:
    """``kind:start:end`` by start, then by the order of the kinds; or the
    scores in that order."""

    def tagged(i: int, name: str) -> Column:
        text = lambda s: s["score"].cast("string") if score else F.concat_ws(":", F.lit(name), s["start"], s["end"])
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), text(s).alias("text")))

    every = F.concat(*[tagged(i, k.name) for i, k in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: s["text"]), ",")


def redact(docs: DataFrame, text: str = "text", kinds=BASE + ADDED) -> DataFrame:
    """``docs`` with every confirmed span replaced by ``<KIND>``; where
    spans overlap, the one that starts first (then the longer) stands."""
    found = spans(docs, text, kinds)

    def marked(name: str) -> Column:
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), F.lit(f"<{name.upper()}>").alias("mark")))

    every = F.array_sort(F.concat(*[marked(k.name) for k in kinds]))
    body = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    seed = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        keep = F.substr(body, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["neg"]).alias("at"), F.concat(acc["out"], keep, s["mark"]).alias("out")))

    clean = F.aggregate(every, seed, step, lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1)))
    return found.select(*[clean.alias(text) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])

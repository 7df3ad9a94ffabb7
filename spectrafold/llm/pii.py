"""Personal data, with DataFrame functions alone: patterns propose spans, checksums confirm them, context adjusts the score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths of bank account numbers (IBAN) by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}

# Kinds in the order of results. Possessive quantifiers and a start that can't be inside a run of the same characters keep
# matching linear and free of recursion on any text; they match what the plain pattern beside them does.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + ")",
}
KINDS = tuple(PATTERNS)
#: What a text must have for a pattern to be tried on it.
_HINTS = {"email": "@", "phone": "+", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){15}", "iban": r"[A-Z]{2}[0-9]{2}"}

#: Score of a confirmed span without context, and words nearby that raise or lower it by CONTEXT_WEIGHT.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95}
RAISE = {
    "email": "mail|contact|write|courriel|correo|kontakt", "ip": r"\bip\b|host|server|address|adresse|login|client",
    "card": "card|visa|master|credit|karte|carte|tarjeta|payment", "phone": "phone|call|tel|mobile|fax|contact|anruf|appel",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
LOWER = {
    "email": "example|noreply", "ip": "version|release|chapter|section", "card": "isbn|serial|order|tracking|sku",
    "phone": "isbn|serial|order|version", "iban": "serial|sku",
}
CONTEXT_CHARS, CONTEXT_WEIGHT = 40, 0.2
#: Kinds that the method adds to the plain patterns need this score.
ADDED, ADDED_SCORE = ("iban",), 0.5

_BLOCK = 256


def scan(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Exclusive running fold of an array: the fold of all entries before each. Two levels keep long arrays cheap."""
    def running(block: Column) -> Column:
        return F.aggregate(block, F.array(zero), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda j: running(F.slice(values, j * _BLOCK + 1, _BLOCK)))
    before = running(F.transform(blocks, lambda b: F.element_at(b, -1)))
    out = F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)),
                               lambda b, o: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: combine(o, x))))
    return F.when(F.size(values) > 0, out).otherwise(F.slice(F.array(zero), 1, 0))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (capitals and digits, no spaces) passes the mod-97 check."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    codes = F.transform(F.regexp_extract_all(moved, F.lit("[0-9A-Z]"), F.lit(0)), lambda x: F.conv(x, 36, 10).cast("int"))
    return F.aggregate(codes, F.lit(0), lambda r, x: (r * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _confirmed(kind: str, found: Column, before: Column, after: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(found)).between(16, 19) & luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    if kind == "iban":
        apart = ~F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left(after, F.lit(1)).rlike("[A-Za-z0-9]")
        return apart & mod97(F.regexp_replace(found, " ", ""))
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(after, F.lit(CONTEXT_CHARS))))
    score = F.lit(PRIOR[kind]) + F.when(near.rlike(RAISE[kind]), CONTEXT_WEIGHT).otherwise(0.0) - F.when(near.rlike(LOWER[kind]), CONTEXT_WEIGHT).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def _spans(kind: str, found: Column, gaps: Column) -> Column:
    """Structs of the confirmed matches; gaps are the texts before, between and after the matches."""
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: (F.length(g) + F.length(f)).cast("long"))
    offsets = scan(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
    at = F.transform(F.arrays_zip(found.alias("found"), offsets.alias("offset")), lambda x, i: F.struct(
        x["found"].alias("found"), (x["offset"] + F.length(F.get(gaps, i))).alias("start"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after")))
    good = F.filter(at, lambda x: _confirmed(kind, x["found"], x["before"], x["after"]))
    out = F.transform(good, lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["found"])).alias("end"),
        x["found"].alias("text"), _score(kind, x["before"], x["after"]).alias("score")))
    return F.filter(out, lambda x: x["score"] >= ADDED_SCORE) if kind in ADDED else out


def with_spans(docs: DataFrame, text_column: str = "text", into: str = "pii") -> DataFrame:
    """*docs* and a column *into*: array of (kind, start, end, text, score) by kind as in KINDS, then start.

    Positions count code points, end exclusive. Matches are leftmost and do not overlap within a kind; those that fail
    their check (parts of an address at most 255; 16 to 19 digits and Luhn; 8 to 15 digits; mod-97) are dropped and not
    retried. Context words within CONTEXT_CHARS change the score alone, except for added kinds, which need ADDED_SCORE.
    Null and empty texts have no spans; other columns and repeated rows stay (a column named *into* is replaced).
    """
    columns = [c for c in docs.columns if c != into]
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    own = [F.col(f"`{c}`") for c in columns]
    none = F.array().cast("array<string>")
    hinted = {k: F.contains(text, F.lit(h)) if len(h) == 1 else text.rlike(h) for k, h in _HINTS.items()}
    wanted = {k: F.when(hinted[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()}
    found = docs.select(*own, F.struct(*[x.alias(k) for k, x in wanted.items()]).alias("__found"))
    gaps = {k: F.when(F.size(F.col(f"__found.{k}")) > 0, F.split(text, p, -1)).otherwise(none) for k, p in PATTERNS.items()}
    cut = found.select(*own, "__found", F.struct(*[x.alias(k) for k, x in gaps.items()]).alias("__gaps"))
    spans = F.concat(*[_spans(k, F.col(f"__found.{k}"), F.col(f"__gaps.{k}")) for k in KINDS])
    some = F.expr(" or ".join(f"size(__found.{k}) > 0" for k in KINDS))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>")
    return cut.select(*own, F.when(some, spans).otherwise(empty).alias(into))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(docs: DataFrame, text_column: str = "text", count_column: str | None = "n_chars") -> DataFrame:
    """*docs* with every span replaced by its kind in capitals and brackets; overlapping spans become one, named by the first.

    Texts without a span are left as they are, nulls too. A column *count_column*, if there is one, becomes the new length
    of changed texts.
    """
    columns = docs.columns
    spotted = with_spans(docs, text_column, "__pii")
    text = F.col(f"`{text_column}`")
    ordered = F.array_sort(F.transform("__pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    size = 1024
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    has = F.size("__pii") > 0
    cut = spotted.select(*[F.col(f"`{c}`") for c in columns], F.when(has, ordered).alias("__spans"), F.when(has, blocks).alias("__blocks"))
    tos = scan(F.transform("__spans", lambda x: x["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
    done = cut.withColumn("__to", F.when(F.col("__spans").isNotNull(), tos))

    def piece(a: Column, b: Column) -> Column:
        i, j = F.floor(a / size).cast("int"), F.floor((b - 1) / size).cast("int")
        first, last = F.get("__blocks", i), F.get("__blocks", j)
        low, high = (a - i * size + 1).cast("int"), (b - j * size).cast("int")
        within = F.substr(first, low, (b - a).cast("int"))
        over = F.concat(F.substr(first, low), F.array_join(F.slice("__blocks", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.left(last, high))
        return F.when(b <= a, "").when(i == j, within).otherwise(over)

    parts = F.transform(F.arrays_zip("__spans", "__to"), lambda x: F.when(
        x["__spans"]["start"] >= x["__to"], F.concat(piece(x["__to"], x["__spans"]["start"]), F.lit("["), F.upper(x["__spans"]["kind"]), F.lit("]"))).otherwise(""))
    tail = piece(F.array_max(F.transform("__spans", lambda x: x["end"])), F.length(text).cast("long"))
    changed = F.col("__spans").isNotNull()
    out = done.withColumn("__new", F.when(changed, F.concat(F.array_join(parts, ""), tail)).otherwise(text))
    named = []
    for c in columns:
        if c == text_column:
            named.append(F.col("__new").alias(c))
        elif c == count_column:
            named.append(F.when(changed, F.length("__new")).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c))
        else:
            named.append(F.col(f"`{c}`"))
    return out.select(*named)

"""Personal data in texts, with Spark SQL expressions only.

Regular expressions propose spans, checksums (Luhn, mod-97) and ranges confirm them, and whole words within WINDOW
characters on either side of a span, matches included, adjust its score. Offsets come from pairing the matches of a pattern with the pieces between them, which the same engine splits at
the same places; their lengths add up in blocks, so a text with very many matches costs no quadratic copying.

Base kinds (email, ip, card, phone) are always reported; iban and ssn are added where their score reaches `least`.
Nulls and empty texts have no spans. Rows are independent: ties, repeats, empty tables and further columns, also ones
named like the output's, are kept as they are (a clashing output name is refused).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

#: The length of an IBAN by country.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


#: Characters on either side of a span that its words may stand in, what one adds, and matches of a block.
WINDOW, BOOST, BLOCK = 40, 0.2, 256
#: One more, which says whether a word goes on beyond the window.
REACH = WINDOW + 1
AFTER = rf"([\s\S]{{0,{REACH}}})"


def iban() -> str:
    """The head of an IBAN, country and check digits, before the rest of its country's length: group 1 is all of it, 2 what follows.

    As only heads are taken from the text, one that fails its check hides no other. Codes of no listed country take any length.
    """
    known = "|".join(LENGTHS.values()).replace(" ", "|")
    rest = [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + rf"\x20?[A-Z0-9]{{{n % 4}}}" * (n % 4 > 0) for n, c in LENGTHS.items()]
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join([*rest, other])})(?![A-Za-z0-9])){AFTER})[A-Z]{{2}}[0-9]{{2}}"


#: The patterns. Each is the base pattern with possessive repeats and a start that is tried once per run of
#: its characters (or right after the match before), which finds the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this can't have a span of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"-[0-9]{2}-"}
#: What a confirmed span scores, and the words beside it that add to that, with or without an s behind.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
WORDS = {
    "email": ("mail", "email", "contact", "kontakt", "contacto", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "credit", "karte", "kreditkarte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "telephone", "telefon", "téléphone", "tel", "call", "mobile", "fax", "teléfono", "handy"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax"),
}
#: A match has two characters at least, so this many reach over the window.
BACK = REACH // 2 + 1


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The check of IBANs: country and check digits behind the rest, letters as 10 to 35, remainder 1."""
    s = F.regexp_replace(iban, " ", "")
    s = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def add(r: Column, i: Column) -> Column:
        v = F.conv(F.substring(s, i, F.lit(1)), 36, 10).cast("int")
        return (r * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1


def confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: m.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": lambda: F.length(digits).between(13, 19) & luhn(digits),
        "phone": lambda: F.length(digits).between(9, 15),
        "iban": lambda: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m),
        "ssn": lambda: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    }[kind]()


def pieces(text: Column, kind: str) -> Column:
    """[(gap, pre, len, own, m, post)]: the matches with the length and the end of the text since the one before, and what follows.

    `m` may go on behind `own`.
    """
    p = PATTERNS[kind]
    own = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    if kind == "iban":
        found = F.arrays_zip(own.alias("own"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("m"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("post"))
    else:
        found = F.arrays_zip(own.alias("own"), own.alias("m"), F.regexp_extract_all(text, F.lit(f"{p}(?={AFTER})"), F.lit(1)).alias("post"))
    both = F.zip_with(
        F.split(text, p, -1), found,
        lambda o, x: F.struct(F.length(o).alias("gap"), F.substring(o, -REACH, REACH).alias("pre"), F.length(x["own"]).alias("len"), x["own"].alias("own"), x["m"].alias("m"), x["post"].alias("post")),
    )
    has = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDS[kind])
    return F.when(has, F.filter(both, lambda x: x["m"].isNotNull()))


def named(kind: str, before: Column, after: Column) -> Column:
    """One of the kind's words stands whole on either side; a side shorter than REACH is all the text there is."""
    words, letter = f"(?:{'|'.join(WORDS[kind])})s?", r"[\p{L}\p{N}]"
    edge = lambda c: F.when(F.length(c) < REACH, F.lit(" ")).otherwise(F.lit(""))
    left, right = F.lower(F.concat(edge(before), before)), F.lower(F.concat(after, edge(after)))
    return left.rlike(f"(?!{letter}).{words}(?!{letter})") | right.rlike(f"(?<!{letter}){words}(?!{letter}).")


def placed(items: Column, kind: str) -> Column:
    """[(kind, start, end, score)] of the confirmed matches."""

    def step(acc: Column, x: Column) -> Column:
        at, before = acc["at"] + x["gap"], F.right(F.concat(acc["before"], x["pre"]), F.lit(REACH))
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(named(kind, before, x["post"]), BOOST).otherwise(0.0))
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(x["m"])).alias("end"), score.alias("score"))
        spans = F.when(confirmed(kind, x["m"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((at + x["len"]).alias("at"), F.right(F.concat(before, x["own"]), F.lit(REACH)).alias("before"), spans.alias("spans"))

    def lengths(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("long"), lambda s, x: s + x["gap"] + x["len"])

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    # Blocks and where each begins: sums of whole blocks first, so no list longer than a block is copied per match.
    blocks = in_blocks(items)
    starts = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + lengths(b))))
    # The text before a block, of the last matches of the block before.
    ends = F.transform(blocks, lambda b: F.right(F.array_join(F.transform(F.slice(b, -F.least(F.size(b), F.lit(BACK)), F.lit(BACK)), lambda x: F.concat(x["pre"], x["own"])), ""), F.lit(REACH)))
    begins = F.zip_with(starts, F.concat(F.array(F.lit("")), ends), lambda s, t: F.struct(s.alias("at"), t.alias("before"), none.alias("spans")))
    found = F.zip_with(blocks, begins, lambda b, s: F.when(b.isNotNull(), F.aggregate(b, s, step)["spans"]).otherwise(none))
    return F.when(F.size(items) > 0, F.flatten(found)).otherwise(none)


def in_blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii", least: float = 0.5) -> DataFrame:
    """`df` with column `out`: array of (kind, start, end, score), by kind, then start; code points, end exclusive."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    names = fresh(df, *[f"_{k}" for k in KINDS])
    body = F.coalesce(F.col(text), F.lit(""))
    items = df.select("*", *[pieces(body, k).alias(c) for k, c in zip(KINDS, names, strict=True)])
    spans = F.concat(*[placed(F.col(c), k) if k in BASE else F.filter(placed(F.col(c), k), lambda x: x["score"] >= least) for k, c in zip(KINDS, names, strict=True)])
    return items.select(*[F.col(f"`{c}`") for c in df.columns], spans.alias(out))


def redact(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """`df` with every span of `text` replaced by its kind in angle brackets; where spans overlap, the first one's kind."""
    (pii,) = fresh(df, "_pii")
    found = find_pii(df, text, pii, least)
    body = F.col(f"`{text}`")
    order = F.array_sort(F.transform(F.col(pii), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    blocks = in_blocks(order)
    # Where a block begins is the furthest end before it, and its text reaches to the start of its last span.
    tops = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda s, b: F.concat(s, F.array(F.greatest(F.element_at(s, -1), F.array_max(F.transform(b, lambda x: x["end"]))))))
    cut = lambda c, a, n: F.substring(c, (a + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))

    def replaced(block: Column, base: Column) -> Column:
        """The block's text from `base` on, as a list of gaps and names."""
        own = cut(body, base, F.element_at(block, -1)["start"] - base)

        def step(acc: Column, x: Column) -> Column:
            # A span that begins within the one before only extends it.
            name = F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))
            more = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(cut(acc["own"], acc["at"] - base, x["start"] - acc["at"]), name))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["own"].alias("own"), more.alias("out"))

        return F.aggregate(block, F.struct(base.alias("at"), own.alias("own"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.array_join(acc["out"], ""))

    parts = F.zip_with(blocks, tops, lambda b, t: F.when(b.isNotNull(), replaced(b, t)).otherwise(F.substr(body, (t + 1).cast("int"))))
    return found.select(*[F.when(F.size(pii) > 0, F.array_join(parts, "")).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

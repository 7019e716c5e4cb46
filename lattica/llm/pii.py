"""Personal data: base patterns plus gradient boosted candidates.

Base spans of four kinds come from fixed patterns and checks. What they cover is masked, character by character, so nothing is
found twice. High-recall generators then propose spans in the rest; each gets format and context features, and gradient boosted
trees score it. There are no labels, so the trees learn from rewritten data: valid values of each kind in forms that the base
patterns miss (spelled, bracketed, spaced, other separators) against look-alikes (dates, order numbers, versions, failed checks)
and against what the generators propose in all documents. Thresholds are calibrated on rows held out from the
fit. Finding is an expression inside the row: no shuffle, no Python, and work linear in the text.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
#: Rows of rewritten data.
SYNTHETIC = 16_000
TREES, DEPTH = 10, 4
#: Part of the negatives held out that may reach a kind's threshold.
FALSE_RATE = 0.002

#: Characters of base spans; each has a masked form for each kind, in a private block of code points.
PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-@ ()"
BLOCK, PRIVATE = 0x80, r"\uE000-\uE1FF"


def _masked(kind: str) -> str:
    """PLAIN in the masked form of a kind."""
    return "".join(chr(0xE000 + BLOCK * KINDS.index(kind) + i) for i in range(len(PLAIN)))


def _wide(chars: str) -> str:
    """Class members for some characters of PLAIN and their masked forms."""
    at = [PLAIN.index(c) for c in chars]
    edges = [i for i in at if i - 1 not in at]
    ranges = []
    for first in edges:
        last = first
        while last + 1 in at:
            last += 1
        ranges += [f"\\u{0xE000 + BLOCK * k + first:04X}-\\u{0xE000 + BLOCK * k + last:04X}" for k in range(len(KINDS))]
    return "".join("\\x%02X" % ord(c) for c in chars) + "".join(ranges)


_DIGIT, _ALNUM = PLAIN[:10], PLAIN[:62]
_D, _DOT, _USER, _HOST = f"[{_wide(_DIGIT)}]", f"[{_wide('.')}]", _wide(_ALNUM + "._%+-"), f"[{_wide(_ALNUM + '-')}]"
#: Leftmost matches of the contract's patterns, masked characters counting as their plain ones. A match starts at the end of the
#: one before or where no character of its first class precedes, which any leftmost match does; with possessive runs each run of
#: characters is tried once.
BASE = {
    "email": rf"(?:\G|(?<![{_USER}]))[{_USER}]++[{_wide('@')}]{_HOST}++(?:{_DOT}{_HOST}++)++",
    "ip": rf"(?:\G|(?<!{_D})){_D}++{_DOT}{_D}++{_DOT}{_D}++{_DOT}{_D}++",
    "card": rf"(?:\G|(?<!{_D})){_D}(?:[{_wide(' -')}]?{_D})++",
    "phone": rf"[{_wide('+')}]{_D}[{_wide(_DIGIT + ' ().-')}]+{_D}",
}
_AT = r"(?:\x20?[(\[{<]\x20?(?:[aA][tT]|@)\x20?[)\]}>]\x20?|\x20[aA][tT]\x20|\x20?@\x20?)"
_POINT = r"(?:\x20?[(\[{<]\x20?(?:[dD][oO][tT]|\.)\x20?[)\]}>]\x20?|\x20[dD][oO][tT]\x20|\x20\.\x20|\.)"
#: High-recall generators over what base spans leave.
GENERATORS = {
    "email": rf"(?<![A-Za-z0-9._%+{PRIVATE}-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_POINT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9{PRIVATE}])[0-9]{{1,3}}+(?:{_POINT}[0-9]{{1,3}}+){{3}}(?![0-9{PRIVATE}])",
    "card": rf"(?<![0-9{PRIVATE}])[0-9]{{1,19}}+(?:[\x20./_-]{{1,3}}[0-9]{{1,19}}+){{0,8}}+(?![0-9{PRIVATE}])",
    "phone": rf"(?<![0-9{PRIVATE}])(?:\+|\()?[0-9][0-9().\x20/-]{{5,22}}[0-9](?![0-9{PRIVATE}])",
}
#: Digits of a candidate that can be of the kind at all.
DIGITS = {"email": (0, 1 << 30), "ip": (4, 12), "card": (14, 19), "phone": (9, 15)}
_CUES = {
    "email": "(?i)(?:mail|contact|write|reach|send|address)",
    "ip": r"(?i)(?:\bip\b|host|server|addr|node|from|ping|gateway)",
    "card": "(?i)(?:card|visa|master|amex|pay|credit|charge|billing)",
    "phone": "(?i)(?:call|tel|phone|mobile|fax|cell|sms|ring|dial)",
}
_TOP = "com|org|net|edu|gov|io|co|uk|de|fr|es|it|nl|ch|at|eu|us|info|biz|dev|app|me|ca|au|in|jp|br|ru|pl|se|no"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(ds: Column) -> Column:
    """True if the string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(ds, F.length(ds) - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(ds)), F.lit(0), add) % 10 == 0


def _octets(m: Column) -> Column:
    parts = F.transform(F.split(m, r"[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p.try_cast("int")), F.lit(999)) <= 255))


def valid(kind: str, m: Column) -> Column:
    """The base check of a match of the base pattern."""
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return let(digits(m), lambda ds: F.when(F.length(ds).between(14, 19), luhn(ds)).otherwise(F.lit(False)))
    return F.length(digits(m)).between(10, 15) if kind == "phone" else F.lit(True)


_STEP = 64


def _starts(entries: Column) -> Column:
    """Start offset of each STEP entries (gap, len): sums of whole blocks before it."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["len"])
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(entries) - 1) / _STEP).cast("int")), lambda b: total(F.slice(entries, b * _STEP + 1, F.lit(_STEP))))
    return let(sums, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), F.lit(0), lambda a, x: a + x)))


def _placed(entries: Column, kind: str) -> Column:
    """Entries (gap, len, info) with offsets: blocks of them, each from its start on, so long lists cost no more a span."""
    none = F.array().cast("array<int>")
    add = lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["gap"])).alias("out"))

    def block(begin: Column, b: Column) -> Column:
        own = F.slice(entries, b * _STEP + 1, F.lit(_STEP))
        ends = F.aggregate(own, F.struct(begin.alias("at"), none.alias("out")), add, lambda s: s["out"])
        return F.zip_with(own, ends, lambda x, at: F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (at + x["len"]).alias("end"), F.lit(kind).alias("kind"), x["ok"].alias("ok"), x["info"].alias("info")))

    return let(_starts(entries), lambda starts: F.flatten(F.transform(starts, block)))


def searched(text: Column, pattern: str, kind: str, judge: Callable[[Column], Column], info: str) -> Column:
    """Struct of spans and text: what ``judge`` accepts of the matches, and the text with that masked.

    ``judge`` takes a struct of m (the match, unmasked), before and after (the text around) and gives a struct of ok and info
    (of type ``info``). Spans are (start, ord, end, kind, info); offsets are code points, end exclusive.
    """
    wide, forms = "".join(map(_masked, KINDS)), _masked(kind)
    kinds = f"array<struct<start:int,ord:int,end:int,kind:string,info:{info}>>"
    nothing = F.struct(F.array().cast(kinds).alias("spans"), text.alias("text"))

    def entry(gaps: Column) -> Callable[[Column, Column], Column]:
        def of(m: Column, i: Column) -> Column:
            plain = F.when(m.rlike(f"[{PRIVATE}]"), F.translate(m, wide, PLAIN * len(KINDS))).otherwise(m)
            around = F.struct(plain.alias("m"), F.right(gaps[i], F.lit(24)).alias("before"), F.left(gaps[i + 1], F.lit(4)).alias("after"))
            return let(let(around, judge), lambda j: F.struct(m.alias("m"), gaps[i].alias("g"), F.length(gaps[i]).alias("gap"), F.length(m).alias("len"), j["ok"].alias("ok"), j["info"].alias("info")))

        return of

    def result(found: Column) -> Callable[[Column], Column]:
        def of(gaps: Column) -> Column:
            def out(entries: Column) -> Column:
                spans = F.transform(F.filter(_placed(entries, kind), lambda s: s["ok"]), lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"], s["info"]))
                pieces = F.transform(entries, lambda x: F.concat(x["g"], F.when(x["ok"], F.translate(x["m"], PLAIN, forms)).otherwise(x["m"])))
                covered = F.concat(F.array_join(pieces, ""), gaps[F.size(found)])
                return F.when(F.exists(entries, lambda x: x["ok"]), F.struct(spans.cast(kinds).alias("spans"), covered.alias("text"))).otherwise(nothing)

            return let(F.transform(found, entry(gaps)), out)

        return of

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) > 0, let(F.split(text, pattern, -1), result(f))).otherwise(nothing))


def masked(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with b_<kind> (base spans) and masked (the text with base spans in masked form); null texts are empty.

    Characters of the text that are themselves in the private block count as U+FFFD.
    """
    text = F.coalesce(text, F.lit(""))
    df = docs.withColumn("__t", F.when(text.rlike(f"[{PRIVATE}]"), F.regexp_replace(text, f"[{PRIVATE}]", "\uFFFD")).otherwise(text))
    passes = lambda kind: lambda e: F.struct(valid(kind, e["m"]).alias("ok"), F.lit(1.0).alias("info"))
    for kind in KINDS:
        df = df.withColumn("__s", searched(F.col("__t"), BASE[kind], kind, passes(kind), "double"))
        df = df.withColumn(f"b_{kind}", F.col("__s.spans")).withColumn("__t", F.col("__s.text")).drop("__s")
    return df.withColumnRenamed("__t", "masked")


FEATURES = (
    "length n_digits groups longest shortest last_group letters brackets spaces dots slashes dashes underscores plus zeros luhn octets top at_mark spelled cue date digit_near letter_before letter_after".split()
)


_INFO = "struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">"
_CANDIDATES = f"array<struct<start:int,ord:int,end:int,kind:string,info:{_INFO}>>"


def _features(kind: str, e: Column) -> Column:
    """Format and context of a candidate."""
    m, before, after = e["m"], e["before"], e["after"]
    groups = F.filter(F.split(m, "[^0-9]+" if kind != "email" else "[^A-Za-z0-9-]+"), lambda g: F.length(g) > 0)
    count = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))

    def made(x: Column) -> Column:
        n, widths = F.length(x["ds"]), x["widths"]
        values = {
            "length": F.length(m), "n_digits": n, "groups": F.size(widths), "longest": F.array_max(widths), "shortest": F.array_min(widths), "last_group": F.element_at(widths, -1),
            "letters": count("A-Za-z"), "brackets": count(r"(\[{<"), "spaces": count(r"\x20"), "dots": count("."), "slashes": count("/"), "dashes": count("-"), "underscores": count("_"),
            "plus": m.startswith("+"), "zeros": m.rlike(r"^\(?00"), "luhn": F.when(n.between(14, 19), luhn(x["ds"])).otherwise(F.lit(False)) if kind == "card" else F.lit(False),
            "octets": _octets(m) if kind == "ip" else F.lit(False), "top": m.rlike(rf"(?i)[^A-Za-z0-9-](?:{_TOP})$") if kind == "email" else F.lit(False), "at_mark": m.contains("@"),
            "spelled": m.rlike(r"(?i)\b(?:at|dot)\b"), "cue": before.rlike(_CUES[kind]), "date": m.rlike(r"^\(?(?:[12][0-9]{3}[-/.][01]?[0-9][-/.][0-3]?[0-9]|[0-3]?[0-9][-/.][0-3]?[0-9][-/.][12][0-9]{3})"),
            "digit_near": before.rlike("[0-9][-.,/:]?$") | after.rlike("^[-.,/:]?[0-9]"), "letter_before": before.rlike(r"\p{L}$"), "letter_after": after.rlike(r"^\p{L}"),
        }
        return F.struct(*[F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])

    return let(F.struct(digits(m).alias("ds"), F.transform(groups, lambda g: F.length(g)).alias("widths")), made)


def _possible(kind: str, m: Column) -> Column:
    return F.length(digits(m)).between(*DIGITS[kind])


def candidates(kind: str, text: Column) -> Column:
    """Spans that the generator of a kind proposes in a masked text, with their features as info."""
    judge = lambda e: F.struct(_possible(kind, e["m"]).alias("ok"), _features(kind, e).alias("info"))
    return searched(text, GENERATORS[kind], kind, judge, _INFO)["spans"]


def _tree(node, f: Column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(f[FEATURES[split.featureIndex()]] <= float(split.threshold()), _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


def _probability(trees: list, f: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * functools.reduce(operator.add, [F.lit(w) * _tree(t, f) for w, t in trees])))


class Draw:
    """Hash-random choices for the row ``id``."""

    def __init__(self) -> None:
        self.n = 0

    def below(self, n: int) -> Column:
        self.n += 1
        return F.pmod(F.xxhash64("id", F.lit(self.n)), F.lit(n)).cast("int")

    def one(self, options: list) -> Column:
        return F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in options]), self.below(len(options)) + 1)

    def number(self, n: int) -> Column:
        """``n`` random digits."""
        self.n += 1
        ds = F.translate(F.md5(F.concat_ws(":", F.col("id"), F.lit(f"n{self.n}"))), "abcdef", "273859")
        return ds.substr(1, n)

    def word(self, least: int, most: int) -> Column:
        self.n += 1
        letters = F.translate(F.md5(F.concat_ws(":", F.col("id"), F.lit(f"w{self.n}"))), "0123456789", "ghijklmnop")
        return letters.substr(F.lit(1), self.below(most - least + 1) + least)


def _card(d: Draw) -> Column:
    """Digits of a card number that passes the check: 14 to 19, mostly 16."""
    body = d.one([d.number(15)] * 4 + [d.number(14), d.number(13), d.number(18)])
    return let(body, lambda b: F.concat(b, F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: c.cast("string")), lambda c: luhn(F.concat(b, c)))[0]))


def _fours(ds: Column, gap: Column) -> Column:
    """Digits in groups of four."""
    return F.regexp_replace(F.regexp_replace(ds, "([0-9]{4})(?=[0-9])", "$1~"), F.lit("~"), gap)


def _synthetic(spark: SparkSession, rows: int) -> DataFrame:
    """id, kind, label, cue, value: values in forms beyond the base patterns, and look-alikes."""
    d, octet = Draw(), lambda: d.below(256).cast("string")
    top, ats, dots = d.one("com org net edu io co de fr".split()), [" at ", " [at] ", " (at) ", "[at]", "(at)", "{at}", " AT ", " @ ", "(@)"], [" dot ", " [dot] ", " (dot) ", "[dot]", "(dot)", "{dot}", " DOT ", "[.]"]
    user = F.concat(d.word(2, 8), d.one(["", ".", "_", "-"]), d.one(["", d.word(1, 7), d.number(2)]))
    at, dot, host = d.one(ats), d.one([*dots, "."]), d.word(3, 10)
    pair = d.below(3)
    # at least one of the two marks is rewritten; spelled marks mostly go together
    at, dot = F.when((dot == ".") & (at == " at "), F.lit(" [at] ")).otherwise(at), F.when(pair == 0, F.lit(".")).otherwise(dot)
    at = F.when((dot == ".") & at.isin(" at ", " AT "), F.lit("(at)")).otherwise(at)
    email = F.concat(user, at, F.when(d.below(4) == 0, F.concat(d.word(3, 7), dot)).otherwise(F.lit("")), host, dot, top)
    prose = d.one("arrive look stayed priced sold meet rate aimed bought".split())
    no_email = d.one([
        F.concat(prose, F.lit(" at "), d.word(3, 9), F.lit("."), d.one([d.word(2, 6), "The", "html", "py", "And"])), F.concat(d.number(2), F.lit(" @ "), d.number(1), F.lit("."), d.number(2)), F.concat(prose, F.lit(" at "), d.number(2), F.lit("."), d.number(2)),
        F.concat(d.word(3, 8), F.lit(" at "), d.one([d.word(3, 9), "noon"]), F.lit(" dot "), d.word(4, 8)), F.concat(prose, F.lit(" at "), d.word(4, 9), F.lit("."), top), F.concat(d.word(3, 8), F.lit(" @"), d.word(3, 9), F.lit(" . "), d.word(3, 8)),
    ])
    point = d.one(["[.]", "(.)", " . ", "[dot]", "(dot)", " dot ", "{.}", " [.] ", " [dot] "])
    ip = F.concat_ws("~", octet(), octet(), octet(), octet())
    wrong = F.concat_ws("~", octet(), d.below(900).cast("string"), (d.below(744) + 256).cast("string"), d.below(900).cast("string"))
    part = lambda n: d.below(n).cast("string")
    no_ip = d.one([F.regexp_replace(wrong, F.lit("~"), point), F.concat(part(12), F.lit(" . "), part(12), F.lit(" . "), part(999), F.lit(" . "), part(999)), F.concat(d.number(3), F.lit("."), d.number(3), F.lit("."), d.number(3), F.lit("."), d.number(3))])
    card = _fours(_card(d), d.one([".", "/", "  ", " - ", "_", " / ", " . ", "--"]))
    random = d.one([d.number(14), d.number(16), d.number(16), d.number(16), d.number(18)])
    failing = F.when(luhn(random), F.concat(random.substr(F.lit(1), F.length(random) - 1), F.pmod(F.right(random, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))).otherwise(random)
    date = F.concat(F.lit("20"), d.number(2), d.one(["-", "/", "."]), F.lit("0"), part(9), d.one(["-", "/", "."]), F.lit("1"), part(9))
    no_card = d.one([failing, _fours(failing, d.one([".", "/", "  ", " - ", "_", " ", "-"])), F.concat(date, F.lit(" "), d.number(6)), F.concat(date, F.lit(" - "), date)])
    a, b, c = d.number(3), d.number(3), d.number(4)
    sep = d.one([" ", "-", ".", "/", " - "])
    phone = d.one([
        F.concat(F.lit("("), a, F.lit(") "), b, d.one(["-", " ", "."]), c), F.concat(a, sep, b, sep, c), F.concat(F.lit("00"), d.one(["1", "44", "49", "33", "351"]), d.one([" ", "-", ""]), a, sep, b, sep, c), F.concat(F.lit("1"), sep, a, sep, b, sep, c),
        F.concat(F.lit("+"), d.one(["1", "44", "49"]), F.lit("/"), a, F.lit("/"), b, F.lit("/"), c), F.concat(F.lit("0"), d.number(2), d.one([" ", "/", "-"]), d.number(3), F.lit(" "), d.number(4)),
    ])
    bare = F.concat(a, b, c)
    no_phone = d.one([
        date, F.concat(date, F.lit(" "), d.number(2)), F.concat(d.number(4), F.lit("-"), d.number(4)), d.number(9), bare, d.number(12), F.concat(d.number(5), F.lit("."), d.number(5)), F.concat(F.lit("978-"), part(9), F.lit("-"), d.number(3), F.lit("-"), d.number(5), F.lit("-"), part(9)),
        F.concat(d.number(2), F.lit(" "), d.number(2), F.lit(" "), d.number(2), F.lit(" "), d.number(3)), F.concat(d.number(6), F.lit(" "), d.number(6)), F.concat(d.number(1), F.lit(". "), d.number(4), F.lit(" - "), d.number(4)),
    ])
    cues = {"email": ["mail me: ", "contact ", "write to ", "e-mail "], "ip": ["host ", "server at ", "IP: ", "ping "], "card": ["card number ", "pay by card ", "visa ", "charge "], "phone": ["call ", "tel. ", "phone: ", "fax "]}
    yes = {"email": email, "ip": F.regexp_replace(ip, F.lit("~"), point), "card": card, "phone": phone}
    no = {"email": no_email, "ip": no_ip, "card": no_card, "phone": no_phone}
    neutral = d.one(["order ", "no. ", "see ", "version ", "on ", "page ", "", "", ""])
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 4 + 1).cast("int"))
    label = (F.col("id") / 4).cast("long") % 2
    pick = lambda table, other=None: functools.reduce(lambda out, k: F.when(F.col("kind") == k, table[k]).otherwise(out), KINDS, other if other is not None else F.lit(""))
    out = spark.range(rows).withColumn("kind", kind).withColumn("label", label)
    cued = F.when((F.col("label") == 1) & (d.below(10) < 6) | (F.col("label") == 0) & (d.below(10) < 1), pick({k: d.one(cues[k]) for k in KINDS}))
    return out.select("id", "kind", "label", F.coalesce(cued, neutral).alias("cue"), F.when(F.col("label") == 1, pick(yes)).otherwise(pick(no)).alias("value"))


def examples(docs: DataFrame, synthetic: int = SYNTHETIC) -> DataFrame:
    """kind, label, held and the features: rewritten values and look-alikes between words of documents, and what the generators
    propose in all documents. Proposals there that pass a kind's strictest check are no examples of either sort."""
    spark = docs.sparkSession
    picked = docs.select("text").filter("text is not null")
    slots, at = 997, F.pmod(F.xxhash64("text", F.lit("at")), F.greatest(F.length("text") - 60, F.lit(1))).cast("int")
    around = picked.select(F.pmod(F.xxhash64("text", F.lit("slot")), F.lit(slots)).alias("slot"), F.substring("text", at + 1, F.lit(30)).alias("left"), F.substring("text", at + 31, F.lit(30)).alias("right"))
    around = around.groupBy("slot").agg(F.min(F.struct("left", "right")).alias("x")).select("slot", "x.left", "x.right")
    made = _synthetic(spark, synthetic).withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)))
    made = made.join(F.broadcast(around), "slot", "left")
    made = made.withColumn("head", F.concat(F.coalesce("left", F.lit("and so it")), F.lit(" "), F.col("cue"))).withColumn("text", F.concat("head", "value", F.lit(" "), F.coalesce("right", F.lit("was, then"))))
    # each row of rewritten data has one value to look at; a document's text counts as one value of no kind from its start to its end
    made = made.select("id", "kind", "label", F.length("head").alias("first"), F.length("value").alias("len"), "text")
    whole = picked.select(F.xxhash64("text").alias("id"), F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("label"), F.lit(0).alias("first"), F.length("text").alias("len"), "text")
    seen = written(masked(made.unionAll(whole), F.col("text")).select("id", "kind", "label", "first", "len", "masked"), "pii-masked")
    found = F.concat(*[F.when(F.coalesce(F.col("kind") == k, F.lit(True)), candidates(k, F.col("masked"))).otherwise(F.array().cast(_CANDIDATES)) for k in KINDS])
    rows = seen.select("id", F.col("kind").isNull().alias("natural"), "label", "first", "len", F.explode(found).alias("c"))
    meets = (F.col("c.start") < F.col("first") + F.col("len")) & (F.col("first") < F.col("c.end"))
    covers = (F.col("c.start") <= F.col("first") + 1) & (F.col("c.end") >= F.col("first") + F.col("len") - 1)
    x = lambda f: F.col(f"c.info.{f}")
    strict = {"email": (x("brackets") > 0) & (x("top") > 0), "ip": x("octets") > 0, "card": x("luhn") > 0, "phone": (x("cue") > 0) & (x("groups") > 1)}
    strict = functools.reduce(lambda out, k: F.when(F.col("c.kind") == k, strict[k]).otherwise(out), KINDS, F.lit(False))
    rows = rows.filter(F.when(F.col("natural"), ~strict).otherwise(meets & (covers | (F.col("label") == 0))))
    return rows.select(F.col("c.kind").alias("kind"), F.col("label").cast("double"), (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(3)) == 0).alias("held"), "c.info.*")


def fit(docs: DataFrame, synthetic: int = SYNTHETIC) -> dict:
    """kind -> (function of a feature struct to a score from 0 to 1, threshold).

    Fitted on two thirds of ``examples``, both classes of equal weight. The threshold is the score that FALSE_RATE of the
    negatives held out reach, 0.5 at least. An empty table leaves the rewritten data.
    """
    rows = written(examples(docs, synthetic), "pii-examples")
    sizes = {(r["kind"], r["label"]): r["count"] for r in rows.filter("not held").groupBy("kind", "label").count().collect()}

    def train(kind: str) -> tuple[Callable[[Column], Column], float]:
        share = sizes[kind, 0.0] / sizes[kind, 1.0]
        own = rows.filter(F.col("kind") == kind).withColumn("weight", F.when(F.col("label") == 1, F.lit(share)).otherwise(F.lit(1.0)))
        own = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(own)
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxMemoryInMB=64, weightCol="weight").fit(own.filter("not held"))
        trees = [(float(w), t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees, strict=True)]
        score = functools.partial(_probability, trees)
        held = rows.filter((F.col("kind") == kind) & F.col("held") & (F.col("label") == 0)).select(F.struct(*FEATURES).alias("f")).select(score(F.col("f")).alias("s"))
        return score, max(0.5, float(held.agg(F.percentile("s", F.lit(1 - FALSE_RATE))).first()[0] or 0.0))

    with ThreadPoolExecutor(2) as pool:
        return dict(zip(KINDS, pool.map(train, KINDS), strict=True))


def _rated(kind: str, score: Callable[[Column], Column], threshold: float) -> Callable[[Column], Column]:
    """The judge of a model: candidates that score above its threshold."""

    def judge(e: Column) -> Column:
        rate = F.when(_possible(kind, e["m"]), let(_features(kind, e), lambda f: score(f))).otherwise(F.lit(0.0))
        return let(rate, lambda s: F.struct((s > threshold).alias("ok"), s.alias("info")))

    return judge


def find(docs: DataFrame, models: dict) -> DataFrame:
    """``docs`` with b_<kind> (base spans), added (spans beyond base, info the score) and masked (the text with all spans masked).

    Kinds go in their order; a span that is added is masked for the kinds after it, so added spans meet neither base spans nor
    each other. They score above their kind's threshold. Write the result before filtering by it: Spark would push the filter, and
    with it all the search, below each step. Null and empty texts have no spans; repeated rows get the same ones. The
    columns made here replace columns of the same names.
    """
    df = masked(docs, F.col("text"))
    for k in models:
        df = df.withColumn("__s", searched(F.col("masked"), GENERATORS[k], k, _rated(k, *models[k]), "double"))
        df = df.withColumn(f"__a_{k}", F.col("__s.spans")).withColumn("masked", F.col("__s.text")).drop("__s")
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,info:double>>")
    return df.withColumn("added", F.concat(none, *[F.col(f"__a_{k}") for k in models])).drop(*[f"__a_{k}" for k in models])


def _listed(parts: list[Column]) -> Column:
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``find`` on all documents; n_spans and n_added count all spans and those beyond base."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = find(docs, fit(docs))
    base = [F.col(f"b_{k}") for k in KINDS]
    counts = [F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    added = F.size("added").cast("long")
    return df.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed([*base, F.col("added")]).alias("spans"), (sum(map(F.size, base)) + added).cast("long").alias("n_spans"), added.alias("n_added"))


def redacted(docs: DataFrame, models: dict) -> DataFrame:
    """``docs`` with what spans cover replaced by the kind in angle brackets.

    Where spans of two kinds overlap, what the earlier kind covers is its own and the rest the later one's; spans of one kind
    without a character between them share one mark. Null texts stay null, other columns stay as they are.
    """
    found = find(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text")), models)
    clean = F.col("masked")
    for i, kind in enumerate(KINDS):
        clean = F.regexp_replace(clean, f"[\\u{0xE000 + BLOCK * i:04X}-\\u{0xE000 + BLOCK * (i + 1) - 1:04X}]+", f"<{kind}>")
    clean = F.when(F.col("text").isNotNull(), clean)
    return found.select(*[clean.alias(c) if c == "text" else F.col(f"__row.{c}").alias(c) for c in docs.columns])

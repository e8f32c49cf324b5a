"""Personal data in text: base patterns, and boosted trees over wider candidates (operator 7).

Everything on the path over documents is DataFrame expressions, row by row: no Python on the executors and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Each base pattern with possessive loops, so that it runs in linear time and constant stack: a match may begin where the last ended or where no
#: character stands that could have begun it earlier, which is where the plain pattern's leftmost match begins.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"(?:\s?[(\[{](?:dot|\.)[)\]}]\s?|\sdot\s|\s\.\s)"
#: Wider generators: name, the kind that they propose, pattern, and what a text must hold for it to be tried. Their spans may overlap, within a kind and between kinds.
WIDE = (
    ("spelled_email", "email", rf"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{{1,64}}+(?:\s?(?:[(\[{{]at[)\]}}]|@)\s?|\sat\s)[A-Z0-9-]{{1,63}}+(?:(?:{_DOT}|\.)[A-Z0-9-]{{1,63}}+){{1,5}}(?![A-Z0-9])", r"(?i)@|[(\[{]at[)\]}]|\sat\s[A-Z0-9-]+(?:\.|\sdot|\s?[(\[{]|\s\.\s)"),
    ("spelled_ip", "ip", rf"(?i)(?<![0-9A-Z.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9A-Z])", r"(?i)[0-9](?:\s?[(\[{]|\sdot\s|\s\.\s)"),
    ("card_fours", "card", r"(?<![0-9A-Za-z.,+-])[0-9]{4}(?:[ ._/-][0-9]{4}){3}(?![0-9A-Za-z])", "[0-9]{4}"),
    ("card_fifteen", "card", r"(?<![0-9A-Za-z.,+-])[0-9]{4}([ ._/-]?)[0-9]{6}\1[0-9]{5}(?![0-9A-Za-z])", "[0-9]{5}"),
    ("phone_groups", "phone", r"(?<![0-9A-Za-z.,+/-])(?:00|\()?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,5}){2,4}(?![0-9A-Za-z])", "[0-9]{2}"),
    ("phone_short", "phone", r"(?<![0-9A-Za-z.,+/-])(?:\([0-9]{3}\)[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{4}|0?[0-9]{10})(?![0-9A-Za-z])", "[0-9]{4}"),
)
#: What a text must hold for a base pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
FOR, AGAINST = r"(?i)(phone|call|tel|fax|mobile|dial|mail|contact|write|reach|card|visa|pay|account|host|server|address|from ip)", r"(?i)(order|invoice|page|version|release|date|since|year|part|no\.|number|ref|id|chapter|section|ratio|score|step|list)"
FEATURES = ("is_email", "is_ip", "is_card", "n_chars", "n_digits", "n_groups", "first", "last", "longest", "shortest", "paren", "square", "dots", "dashes", "blanks", "slashes", "at_sign", "luhn", "year", "octets", "known_top", "said_for", "said_against", "opens_00")
#: Code points of a block of text: a place in a long text is found within its block.
BLOCK = 1024


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of value, which is worked out once a row however often fn uses it, also inside other lambdas."""
    return F.transform(F.array(value), fn)[0]


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks: Column, a: Column, b: Column) -> Column:
    """The code points a to b (exclusive) of a text in blocks."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    of = lambda k: F.element_at(blocks, k + 1)
    apart = F.concat(F.substr(of(first), a - first * BLOCK + 1), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(of(last), 1, b - last * BLOCK))
    return F.when(b <= a, F.lit("")).when(first == last, F.substring(of(first), a - first * BLOCK + 1, b - a)).otherwise(apart)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, b: a + b)


def located(pieces: Column, matches: Column, step: int = 256) -> Column:
    """Array of start, end (code points), match from what split() and regexp_extract_all() give for one pattern.

    The running sums are taken in runs of `step`, so a text with very many matches stays cheap.
    """

    def placed(s: Column, sizes: Column, runs: Column) -> Column:
        def at(m: Column, i: Column) -> Column:
            k = F.floor(i / step).cast("int")
            before = F.element_at(runs, k + 1) + _sum(F.slice(sizes, k * step + 1, i - k * step))
            start = before + F.length(F.element_at(s["p"], i + 1))
            return bound(start, lambda a: F.struct(a.alias("start"), (a + F.length(m)).alias("end"), m.alias("match")))

        return F.transform(s["m"], at)

    def sized(s: Column) -> Column:
        sizes = F.zip_with(F.slice(s["p"], 1, F.size(s["m"])), s["m"], lambda p, m: F.length(p) + F.length(m))
        whole = lambda z: F.transform(F.sequence(F.lit(0), (F.size(z) - 1).cast("int"), F.lit(step)), lambda c: _sum(F.slice(z, F.lit(1), c)))
        return bound(sizes, lambda z: bound(whole(z), lambda runs: placed(s, z, runs)))

    some = F.coalesce(F.size(matches), F.lit(0)) > 0
    return F.when(some, bound(F.struct(pieces.alias("p"), matches.alias("m")), sized)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    return F.call_function("luhn_check", _digits(m))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _valid_span(kind: str, s: Column) -> Column:
    return _valid(kind, s["match"])


def _for(fn: Callable[[str, Column], Column], kind: str) -> Callable[[Column], Column]:
    """fn with its kind fixed; Spark counts the arguments of a lambda, defaults too."""
    return lambda s: fn(kind, s)


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def features(kind: Column, m: Column, left: Column) -> Column:
    """Struct of doubles: the candidate's format, and words of the text before it."""
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    count = lambda chars: F.length(m) - F.length(F.translate(m, chars, ""))
    yes = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))

    def described(g: Column) -> Column:
        sizes = F.transform(g, lambda x: F.length(x))
        octets = (F.size(g) == 4) & F.forall(g, lambda x: (F.length(x) <= 3) & (x.try_cast("int") <= 255))
        values = {
            "is_email": kind == "email", "is_ip": kind == "ip", "is_card": kind == "card", "n_chars": F.length(m), "n_digits": F.length(_digits(m)), "n_groups": F.size(g),
            "first": F.try_element_at(sizes, F.lit(1)), "last": F.try_element_at(sizes, F.lit(-1)), "longest": F.array_max(sizes), "shortest": F.array_min(sizes), "paren": F.contains(m, F.lit("(")), "square": m.rlike(r"[\[{]"),
            "dots": count("."), "dashes": count("-"), "blanks": count(" "), "slashes": count("/"), "at_sign": F.contains(m, F.lit("@")), "luhn": F.when(F.length(_digits(m)) > 11, _luhn(m)).otherwise(False), "year": F.exists(g, lambda x: x.rlike("^(19|20)[0-9]{2}$")),
            "octets": octets, "known_top": m.rlike(r"(?i)[^a-z](com|org|net|edu|gov|info|io|de|fr|es|uk)$"), "said_for": left.rlike(FOR), "said_against": left.rlike(AGAINST), "opens_00": F.startswith(m, F.lit("00")),
        }
        return F.struct(*[yes(values[x]).alias(x) for x in FEATURES])

    return bound(groups, described)


def examples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """id, kind, m, before, label: candidates made by rule from hashed numbers, real formats against dates, versions, part numbers, ratios and the like.

    Formats that numbers of other meanings share (ten or seven digits, fifteen digits in a row) are personal only after words that say so.
    """
    r = lambda k, mod: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(mod)).cast("int")
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), r(k, len(xs)) + 1)
    num = lambda k, size: F.lpad(r(k, 10**size).cast("string"), size, "0")
    join = lambda sep, *xs: F.concat(*[y for i, x in enumerate(xs) for y in ((sep, x) if i else (x,))])
    choose = lambda by, xs: F.element_at(F.array(*xs), by + 1)
    yes = F.col("y") == 1
    sep, area = pick(1, ["-", ".", " "]), (200 + r(3, 800)).cast("string")
    full = [F.concat(F.lit("("), area, F.lit(") "), num(4, 3), F.lit("-"), num(5, 4)), F.concat(F.lit("("), area, F.lit(")"), num(4, 3), pick(40, ["-", " ", ".", ""]), num(5, 4)), join(sep, area, num(4, 3), num(5, 4)), F.concat(F.lit("00"), num(6, 2), F.lit(" "), num(4, 3), F.lit(" "), num(7, 3), F.lit(" "), num(5, 4)), F.concat(F.lit("0"), num(6, 3), sep, num(4, 3), sep, num(5, 4))]
    short = [F.concat(area, num(4, 3), num(5, 4)), F.concat(num(4, 3), sep, num(5, 4))]
    form = r(2, 7)
    phone = choose(form, full + short)
    year, month, day = (1950 + r(9, 90)).cast("string"), F.lpad((1 + r(10, 12)).cast("string"), 2, "0"), F.lpad((1 + r(11, 28)).cast("string"), 2, "0")
    mark = pick(12, ["-", ".", "/"])
    other = [join(mark, year, month, day), join(mark, day, month, year), join(sep, num(4, 2), num(5, 2), num(6, 2)), join(sep, num(4, 4), num(5, 4), num(6, 2)), join(F.lit(" "), num(3, 2), num(4, 3), num(5, 2), num(6, 3)), join(F.lit("."), num(3, 2), num(4, 2), num(5, 3))]
    no_phone = choose(r(8, 8), other + short)
    at, dot = pick(14, [" at ", "(at)", " (at) ", "[at]", " @ ", " AT ", "{at}"]), pick(16, [" dot ", "(dot)", " [dot] ", ".", " . ", " DOT "])
    name, host = pick(13, ["anna", "support", "j.miller", "info", "sales", "tom99", "the", "look", "meet", "arrive"]), pick(15, ["example", "mail3", "host-one"])
    email = F.concat(name, at, F.when(r(41, 3) == 0, F.concat(F.lit("mail"), dot)).otherwise(""), host, dot, pick(17, ["com", "org", "net", "de"]))
    no_email = F.concat(name, pick(42, [" at ", " AT ", " @ "]), pick(43, ["home", "the", "noon", "once", "last", "5"]), pick(44, [".", " . ", " dot "]), pick(45, ["The", "and", "He", "It", "so", "5"]))
    point = pick(46, ["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)", " [.] "])
    octet = lambda k: r(k, 256).cast("string")
    ip = join(point, (10 + r(47, 246)).cast("string"), octet(48), octet(49), octet(50))
    no_ip = choose(r(51, 3), [join(point, r(47, 9).cast("string"), r(48, 9).cast("string"), r(49, 9).cast("string"), r(50, 9).cast("string")), join(point, num(47, 3), (256 + r(48, 700)).cast("string"), num(49, 3), num(50, 2)), join(F.lit(" . "), num(47, 2), r(48, 9).cast("string"), (300 + r(49, 600)).cast("string"), r(50, 9).cast("string"))])
    payload = F.concat(pick(18, ["4", "51", "55", "37"]), num(19, 9), num(20, 6))

    def card_digits(size: int) -> Column:
        p = payload.substr(1, size - 1)
        doubled = _sum(F.transform(F.sequence(F.lit(1), F.lit(size - 1)), lambda i: bound(F.substring(p, i, F.lit(1)).cast("int"), lambda d: F.when((size - 1 - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))))
        check = F.pmod(-doubled, F.lit(10))
        return F.concat(p, F.when(yes | (r(52, 3) == 0), check).otherwise(F.pmod(check + 1 + r(21, 9), F.lit(10))).cast("string"))

    fives, mid = card_digits(15), pick(22, [".", "_", "/", "-", " "])
    fours = bound(card_digits(16), lambda d: join(mid, *[F.substring(d, 1 + 4 * k, 4) for k in range(4)]))
    fifteen = bound(fives, lambda d: join(F.when(r(53, 2) == 0, mid).otherwise(""), F.substring(d, 1, 4), F.substring(d, 5, 6), F.substring(d, 11, 5)))
    is_fifteen = r(54, 2) == 0
    card = F.when(is_fifteen, fifteen).otherwise(fours)
    kind = F.col("kind")
    shared = ((kind == "phone") & yes & (form >= 5)) | ((kind == "card") & yes & is_fifteen)
    said, not_said, neutral = pick(33, ["call ", "phone: ", "write to ", "card ", "pay by card ", "server "]), pick(34, ["order ", "since ", "version ", "page ", "step ", "list "]), pick(35, ["and ", "of the ", "", "in "])
    lead = F.when(shared, pick(55, ["call ", "phone: ", "tel ", "mobile ", "card ", "visa "])).when(r(32, 3) == 0, F.when(yes, said).otherwise(not_said)).otherwise(neutral)
    df = spark.range(n).withColumn("y", r(30, 2)).withColumn("kind", pick(31, ["email", "card", "phone", "phone", "ip"]))
    m = F.when(kind == "card", card).when(kind == "email", F.when(yes, email).otherwise(no_email)).when(kind == "ip", F.when(yes, ip).otherwise(no_ip)).otherwise(F.when(yes, phone).otherwise(no_phone))
    luhn_by_chance = (kind == "card") & ~yes & ~is_fifteen & (r(52, 3) == 0)  # four fours that pass are cards
    return df.select("id", "kind", m.alias("m"), lead.alias("before"), (yes | luhn_by_chance).cast("double").alias("label"))


def _tree_sql(lines: list[str]) -> str:
    """CASE expression of a tree's printed form; features as {k}."""
    line = lines.pop(0).strip()
    if found := re.fullmatch(r"Predict: (\S+)", line):
        return f"{float(found[1])!r}D"
    found = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    if not found:
        raise ValueError(line)
    yes = _tree_sql(lines)
    lines.pop(0)  # the else
    return f"CASE WHEN {{{found[1]}}} <= {float(found[2])!r}D THEN {yes} ELSE {_tree_sql(lines)} END"


class Trees:
    """Boosted trees as Column expressions, with a threshold for each kind.

    threshold: the smallest at which at least least_precision of the held-out examples of a kind above it are true; recall: the share of those found there.
    """

    def __init__(self, spark: SparkSession, n: int = 6000, rounds: int = 10, depth: int = 5, least_precision: float = 0.995):
        known = examples(spark, n).withColumn("f", features(F.col("kind"), F.col("m"), F.col("before"))).select("id", "kind", "label", "f.*")
        table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known).repartition(2)
        held = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(4)) == 0
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=3).fit(table.where(~held))
        self.sql = [(w, _tree_sql(t.toDebugString.rstrip("\n").split("\n")[1:])) for w, t in zip(model.treeWeights, model.trees)]
        scored = known.where(held).select("kind", "label", self.chance(F.struct(*FEATURES)).alias("p")).collect()  # a quarter of n rows
        self.threshold, self.recall = {}, {}
        for kind in KINDS:
            rows = sorted(((r["p"], r["label"]) for r in scored if r["kind"] == kind), reverse=True)
            cut, right = 1.1, 0.0
            for k, (p, y) in enumerate(rows, 1):
                right += y
                if right / k >= least_precision and (k == len(rows) or rows[k][0] < p):
                    cut = max(p, 0.5)
            self.threshold[kind] = cut
            self.recall[kind] = sum(y for p, y in rows if p >= cut) / max(1, sum(y for _, y in rows))

    def chance(self, f: Column) -> Column:
        """Chance that a candidate with features f is true."""
        value = F.lit(0.0)
        for w, sql in self.sql:
            value = value + F.lit(float(w)) * self._case(sql, f)
        return 1 / (1 + F.exp(-2 * value))

    def _case(self, sql: str, f: Column) -> Column:
        def build(s: str) -> tuple[Column, str]:
            if s.startswith("CASE WHEN {"):
                k, limit, rest = re.match(r"CASE WHEN \{(\d+)\} <= (\S+)D THEN (.*)", s, re.S).groups()
                yes, rest = build(rest)
                no, rest = build(rest.removeprefix(" ELSE "))
                return F.when(f[FEATURES[int(k)]] <= float(limit), yes).otherwise(no), rest.removeprefix(" END")
            value, rest = re.match(r"(\S+?)D(.*)", s, re.S).groups()
            return F.lit(float(value)), rest

        return build(sql)[0]


def _tops(ends: Column, step: int) -> Column:
    """The largest of the first 0, step, 2*step, ... ends."""
    return F.transform(F.sequence(F.lit(0), F.size(ends), F.lit(step)), lambda c: F.coalesce(F.array_max(F.slice(ends, F.lit(1), c)), F.lit(0)))


def _reached(ends: Column, tops: Column, i: Column, step: int) -> Column:
    """The largest of the first i ends: that of whole runs of `step`, and of those since."""
    k = F.floor(i / step).cast("int")
    return F.greatest(F.element_at(tops, k + 1), F.coalesce(F.array_max(F.slice(ends, k * step + 1, i - k * step)), F.lit(0)))


def resolved(walls: Column, candidates: Column, step: int = 256, most: int = 1024) -> Column:
    """Those candidates (start, end, kind, p) that overlap no wall and no likelier candidate; of equally likely ones the first stays, and of equal ones one.

    All are sorted by start. Walls that start before a candidate are met by how far they reach, what starts within it by looking at its neighbours: at so
    many as starts of other items lie in any candidate of the row, which the patterns keep under `most`. So many candidates cost in proportion.
    """
    place = lambda s: F.struct(s["start"], s["end"], s["kind"])
    wall = lambda s: s["p"] >= 2
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def kept(xs: Column) -> Column:
        starts_in = lambda s, o: F.coalesce(o["start"] < s["end"], F.lit(False)) & ~wall(s)
        crosses = lambda d: F.exists(F.transform(xs, lambda s, i: starts_in(s, F.try_element_at(xs, i + 1 + d))), lambda x: x)
        width, d = F.lit(most), most // 2
        while d:
            width, d = F.when(~crosses(d), F.lit(d)).otherwise(width), d // 2
        ends = F.transform(xs, lambda s: F.when(wall(s), s["end"]).otherwise(0))

        def stays(s: Column, i: Column, near: Column, ends: Column, tops: Column) -> Column:
            first = F.greatest(F.lit(1), i + 1 - near)
            beaten = F.exists(F.slice(xs, first, i + 1 + near - first + 1), lambda o: meet(o, s) & (wall(o) | (o["p"] > s["p"]) | ((o["p"] == s["p"]) & (place(o) < place(s)))))
            return ~wall(s) & (_reached(ends, tops, i, step) <= s["start"]) & ~beaten

        chosen = lambda near, e, tops: F.filter(xs, lambda s, i: stays(s, i, near, e, tops))
        return bound(width, lambda near: bound(ends, lambda e: bound(_tops(e, step), lambda tops: chosen(near, e, tops))))

    once = lambda xs: F.filter(xs, lambda s, i: (i == 0) | wall(s) | (place(F.element_at(xs, F.greatest(i, F.lit(1)))) != place(s)))
    return bound(bound(F.sort_array(F.concat(walls, candidates)), once), kept)


def find(docs: DataFrame, trees: Trees | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text, base and spans (arrays of kind, start, end; end exclusive, in code points) per row of docs, and the columns in keep.

    base: the leftmost matches of the four patterns that pass their checks, by kind and then start. spans: those, and of the candidates of the wider generators, which may
    overlap each other and the base spans, the ones that the trees give their kind's threshold or more, that overlap no base span and lose to no
    likelier candidate that they overlap (of equals the first stays). Null texts count as empty; a very long text is worked on in blocks, in time in proportion
    to its length; repeated rows give repeated results; an empty table gives none; columns of docs that are neither named nor in keep are ignored,
    whatever their names.
    """
    trees = trees or Trees(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *[docs[c].alias(f"kept_{c}") for c in keep])
    rows = rows.withColumn("digit", text.rlike("[0-9]"))
    patterns = [("b_" + k, BASE[k], F.contains(text, F.lit(NEEDS[k])) if k in NEEDS else F.col("digit")) for k in KINDS]
    patterns += [("w_" + n, p, (F.col("digit") if k != "email" else F.lit(True)) & text.rlike(need)) for n, k, p, need in WIDE]
    rows = rows.withColumns({n + "_m": F.when(need, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for n, p, need in patterns})
    some = lambda n: F.coalesce(F.size(n + "_m"), F.lit(0)) > 0
    rows = rows.withColumns({n + "_p": F.when(some(n), F.split(text, p, -1)) for n, p, _ in patterns})
    rows = rows.withColumns({n: located(F.col(n + "_p"), F.col(n + "_m")) for n, _, _ in patterns})
    named = lambda k, xs: F.transform(xs, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rows.withColumns({"b_" + k: named(k, F.filter(F.col("b_" + k), _for(_valid_span, k))) for k in KINDS})
    rows = rows.withColumn("base", F.concat(*["b_" + k for k in KINDS]))
    proposed = lambda k, xs: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"), s["match"].alias("match")))
    rows = rows.withColumn("proposed", F.concat(*[proposed(k, F.col("w_" + n)) for n, k, _, _ in WIDE]))

    def scored(s: Column, blocks: Column) -> Column:
        left = between(blocks, F.greatest(F.lit(0), s["start"] - 24), s["start"])
        p = bound(features(s["kind"], s["match"], left), trees.chance)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), p.alias("p"))

    limit = lambda kind: F.try_element_at(F.create_map(*[F.lit(x) for kv in trees.threshold.items() for x in kv]), kind)
    likely = bound(blocks_of(text), lambda blocks: F.filter(F.transform("proposed", lambda s: scored(s, blocks)), lambda s: s["p"] >= limit(s["kind"])))
    rows = rows.withColumn("likely", F.when(F.size("proposed") > 0, likely))
    walls = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(2.0).alias("p")))
    rows = rows.withColumn("chosen", F.when(F.coalesce(F.size("likely"), F.lit(0)) > 0, resolved(walls, F.col("likely"))))

    def of(k: str) -> Column:
        both = F.concat(F.col("b_" + k), named(k, F.filter("chosen", of_kind(k))))
        by_place = F.sort_array(F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.when(F.coalesce(F.size("chosen"), F.lit(0)) > 0, named(k, by_place)).otherwise(F.col("b_" + k))

    return rows.select(id_col, "text", "base", F.concat(*[of(k) for k in KINDS]).alias("spans"), *[F.col(f"kept_{c}").alias(c) for c in keep])


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, step: int = 256) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets.

    Where the spans before one end comes from the ends of whole runs of `step` spans and of those since, so a text with very many spans stays cheap.
    """
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def written(blocks: Column, xs: Column, ends: Column, tops: Column) -> Column:
        put = lambda s, done: F.when(s["start"] >= done, F.concat(between(blocks, done, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        parts = F.transform(xs, lambda s, i: bound(_reached(ends, tops, i, step), lambda done: put(s, done)))
        return F.concat(F.array_join(parts, ""), between(blocks, F.array_max(ends), F.length(text)))

    with_ends = lambda blocks, xs: bound(F.transform(xs, lambda s: s["end"]), lambda ends: bound(_tops(ends, step), lambda tops: written(blocks, xs, ends, tops)))
    return F.when(F.size(spans) > 0, bound(blocks_of(text), lambda blocks: bound(ordered, lambda xs: with_ends(blocks, xs)))).otherwise(text)

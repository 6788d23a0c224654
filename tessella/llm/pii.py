"""Personal data: fixed patterns, and bootstrapped contextual extraction that finds identifiers the patterns miss.

Fixed patterns give the base spans of four kinds, and these are the seeds. Lexical patterns are what stands around a seed: the
word before it, the two words before it, the word before with the word after it, or a label of its own word such as `mail:`
and `key=`. Patterns and values form a graph that Spark scores in rounds: a pattern's confidence for a kind is the score of
the values it stands around over all its occurrences in the corpus (those around anything else count against it); a value's
score is one minus the product of the doubts of its patterns, of those with one word before the most confident. Values of
confident patterns with enough different values as support become spans of that kind and raise the scores of the next round.
A value with a mark (a digit, an @, a bracket, a low line, an inner dot) needs a score of `CONFIDENT`, a plain word one of
`PLAIN`. Base spans always stay.

Words are looked at in segments of about `SEGMENT` characters, so that what a task holds of a text is bounded; patterns don't
reach over a segment's end. Seeds stand in these segments as masks: private characters that say their kind and a hash of
their value, so that no list of spans is searched for each word.

All is built-in functions. The fixed patterns are written so that Java's matcher takes linear time and no recursion on any
text; where that needs a text prepared, characters are replaced one by one, so places stay.

Defined results: a null text counts as empty; repeated rows get the same spans; spans are in code points, end exclusive;
private characters (U+E000 to U+F8FF) of a text are read as U+E002; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, row_key, table, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
SPANS = "array<struct<kind:string,s:int,e:int>>"
#: Rounds of scoring; confidence and number of different values that a pattern needs; score that a plain word needs.
ROUNDS, CONFIDENT, SUPPORT, PLAIN = 3, 0.5, 3, 0.75
SEGMENT = 30_000

#: Marks around matches; what stands for characters that can't belong to a match (a dot; a space and a hyphen).
BEGIN, END = "\ue000", "\ue001"
DOT, GAP, DASH = "\ue004", "\ue005", "\ue006"
#: Masks of base spans: four characters for a hash of the value, then one for each kind.
CODES = "".join(chr(0xE100 + i) for i in range(16))
FILL = {k: chr(0xE010 + i) for i, k in enumerate(KINDS)}
MASK = "[\ue010-\ue013\ue100-\ue10f]"

EMAIL = rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9 -])[0-9](?=(?:[ -]?[0-9]){12})[0-9 -]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Groups of digits with blanks between; else a word with a digit, an @, a bracket, a low line or a dot before a letter.
MARK = r"(?:[0-9@(\[{_]|\.(?=\p{L}))"
GROUP = r"\(?[0-9][0-9()/-]*+"
GROUPS = rf"(?:[\p{{L}}_-]++[=:])?+[+(]*+{GROUP}(?:\x20++{GROUP}(?=[\"')>\],.;:!?]*+(?:[\x20\x09-\x0D]|$)))++"
#: What counts as a word: groups of digits together, else anything between white space.
ITEM = rf"(?<![^\x20\x09-\x0D])(?:{GROUPS}|[^\x20\x09-\x0D]++)"
#: What stands somewhere in a text with groups of digits; texts without it are parted at white space.
GROUPED = r"[0-9()/-]\x20++\(?[0-9]"
BLANKS = "\t\n\x0b\x0c\r"
LABEL = r"^[\p{L}_-]+[=:]"
#: What a word has that is more than its value.
WRAPPED = r"[\"'(<\[)>\],.;:!?=]"
OPEN, CLOSE = r"^[\"'(<\[]+", r"(?<![\"')>\],.;:!?])[\"')>\],.;:!?]++$"


MATCHES = "array<struct<s:int,e:int,m:string,rest:string>>"
#: Parts of a text that one fold goes through: folds copy what they have gathered, so long lists are folded piece by piece.
PIECE = 128


def cut(text: Column, pattern: str) -> Column:
    """A text parted before each match of a pattern; the end of a match is marked."""
    return F.split(F.regexp_replace(text, pattern, f"{BEGIN}$0{END}"), BEGIN)


def matches(parts: str) -> Column:
    """All matches in a column of `cut` (null: none), as an array of {s, e, m, rest}; rest is what stands between a match and the one before."""
    p, n = F.col(parts), F.size(parts)
    length = lambda x: F.length(x) - F.when(x.contains(END), 1).otherwise(0)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(PIECE))
    sizes = F.transform(starts, lambda i: F.aggregate(F.slice(p, i, F.lit(PIECE)), F.lit(0), lambda a, x: a + length(x)))

    def piece(i: Column, before: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            m = F.substring_index(x, END, 1)
            one = F.struct(acc["at"].alias("s"), (acc["at"] + F.length(m)).alias("e"), m.alias("m"), acc["rest"].alias("rest"))
            out = F.when(x.contains(END), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
            rest = F.when(x.contains(END), F.substring(x, F.length(m) + 2, F.length(x))).otherwise(x)
            return F.struct((acc["at"] + length(x)).alias("at"), rest.alias("rest"), out.alias("out"))

        last = F.coalesce(F.get(p, i - 2), F.lit(""))
        last = F.when(last.contains(END), F.substring(last, F.length(F.substring_index(last, END, 1)) + 2, F.length(last))).otherwise(last)
        start = F.struct(before.alias("at"), last.alias("rest"), F.array().cast(MATCHES).alias("out"))
        return F.aggregate(F.slice(p, i, F.lit(PIECE)), start, add, lambda a: a["out"])

    def run(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))

    befores = F.aggregate(sizes, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")), run, lambda a: a["all"])
    return F.when(n > 1, F.flatten(F.zip_with(starts, befores, piece))).otherwise(F.array().cast(MATCHES))


def _luhn(m: Column) -> Column:
    turned = F.reverse(F.regexp_replace(m, "[ -]", ""))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _small(x: Column) -> Column:
    digits = F.ltrim(x, F.lit("0"))
    return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)


#: Which matches count.
TESTS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": lambda m: _digits(m).between(13, 19) & _luhn(m),
    "phone": lambda m: _digits(m).between(9, 15),
}


def _parts(kind: str, t: Column) -> Column:
    """A text parted before the matches of a kind; null if it can't have any."""
    if kind == "email":
        # dots that can't part two labels are others, which an address may hold before the @ as well, but never after it
        return F.when(t.contains("@"), cut(F.regexp_replace(t, r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\.", DOT), EMAIL))
    if kind == "ip":
        return F.when(t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), cut(t, IP))
    if kind == "card":
        # spaces and hyphens that don't part two digits end a number
        spaces = F.regexp_replace(t, "(?<![0-9]) | (?![0-9])", GAP)
        return F.when(t.rlike(r"[0-9](?:[ -]?[0-9]){12}"), cut(F.regexp_replace(spaces, "(?<![0-9])-|-(?![0-9])", DASH), CARD))
    return F.when(t.contains("+"), cut(t, PHONE))


def _masked(kind: str, parts: Column, before: Column) -> Column:
    """The text of `parts` with the matches that count masked; each character keeps its place."""

    def one(x: Column) -> Column:
        m = F.substring_index(x, END, 1)
        code = F.translate(F.substring(F.md5(m), 1, 4), "0123456789abcdef", CODES)
        own = F.when(TESTS[kind](m), F.concat(code, F.repeat(F.lit(FILL[kind]), F.length(m) - 4))).otherwise(m)
        return F.when(x.contains(END), F.concat(own, F.substring(x, F.length(m) + 2, F.length(x)))).otherwise(x)

    whole = F.translate(F.array_join(F.transform(parts, one), ""), DOT + GAP + DASH, ". -")
    return F.when(F.size(parts) > 1, whole).otherwise(before)


def _counting(kind: str) -> Column:
    return F.filter(matches(f"__p_{kind}"), lambda x: TESTS[kind](x["m"]))


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with an array of {s, e, m, rest} for each kind, and __m: the text with masks for base spans (of overlapping ones that of the first kind)."""
    t = text_or_empty(text)
    df = df.withColumn("__t", F.when(t.rlike("[\ue000-\uf8ff]"), F.regexp_replace(t, "[\ue000-\uf8ff]", "\ue002")).otherwise(t)).withColumn("__m", F.col("__t"))
    for k in KINDS:
        df = df.withColumn(f"__p_{k}", _parts(k, F.col("__t")))
        # a text without masks so far is parted once
        df = df.withColumn("__q", F.when(F.col("__m") == F.col("__t"), F.col(f"__p_{k}")).otherwise(_parts(k, F.col("__m"))))
        df = df.withColumns({f"__{k}": _counting(k), "__m": _masked(k, F.col("__q"), F.col("__m"))})
    return df.drop("__t", "__q", *[f"__p_{k}" for k in KINDS])


def base_spans(kind: str) -> Column:
    return F.transform(f"__{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def words(t: Column) -> Column:
    """What `ITEM` finds in a text, in order."""
    flat = t
    for blank in BLANKS:
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.when(t.rlike(GROUPED), F.regexp_extract_all(t, F.lit(f"({ITEM})"), F.lit(1))).otherwise(F.array_remove(F.split(flat, " "), ""))


def segments(seen: DataFrame) -> DataFrame:
    """Of rows with __row and __m: __row, seg, at (where the segment begins), part (its text), c (its words as contexts: lower-cased, seeds as #) and w (its words, null where that is the same)."""
    parts = F.regexp_extract_all("__m", F.lit(rf"(?s)(.{{1,{SEGMENT}}}[^\x20\x09-\x0D]*+)"), F.lit(1))
    whole = F.when(F.length("__m") <= SEGMENT, F.array("__m")).otherwise(parts)
    masked = F.col("__seeds") if "__seeds" in seen.columns else F.lit(True)
    cut_ = seen.where("__m <> ''").select("__row", masked.alias("__seeds"), whole.alias("__s")).select("__row", "__seeds", "__s", F.posexplode("__s").alias("seg", "part"))
    at = F.aggregate(F.slice("__s", F.lit(1), F.col("seg")), F.lit(0), lambda a, x: a + F.length(x))
    out = cut_.select("__row", "seg", at.alias("at"), "part", F.lower(F.when(F.col("__seeds"), F.regexp_replace("part", f"{MASK}++", "#")).otherwise(F.col("part"))).alias("__l"))
    out = out.select("__row", "seg", "at", "part", words(F.col("part")).alias("w"), words(F.col("__l")).alias("c"))
    return out.withColumn("w", F.zip_with("w", "c", lambda w, c: F.nullif(w, c)))


def _word(i: Column) -> Column:
    """Word i of a segment as it is written."""
    return F.coalesce(F.get("w", i), F.get("c", i))


def _indexes() -> Column:
    return F.when(F.size("c") > 0, F.sequence(F.lit(0), F.size("c") - 1)).otherwise(F.array().cast("array<int>"))


def _label(i: Column) -> Column:
    x = F.get("c", i)
    return F.when(x.contains("=") | x.contains(":"), F.regexp_extract(x, LABEL, 0)).otherwise("")


def patterns_at(i: Column) -> Column:
    """The patterns of word i of a segment, as texts: its label, or what stands around it."""
    one, label = F.get("c", i - 1), _label(i)
    around = F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), F.get("c", i - 2), F.lit(" "), one), F.concat(F.lit("3 "), one, F.lit(" _ "), F.get("c", i + 1)))
    return F.when(label != "", F.array(F.concat(F.lit("= "), label))).otherwise(around)


def _value(word: Column) -> Column:
    """What a word holds behind its label and between quotes, brackets and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(word, LABEL, ""), OPEN, ""), CLOSE, "")


def _kind(word: Column) -> Column:
    return F.coalesce(*[F.when(word.contains(f), F.lit(k)) for k, f in FILL.items()])


def _plain(word: Column) -> Column:
    return ~word.rlike(MASK) & word.rlike(r"[\p{L}\p{N}]")


def _looked_up(parts: DataFrame, places: DataFrame, **more) -> DataFrame:
    """Places (__row, seg, i, ...) with columns made from their index; only segments that hold a place are read on."""
    own = [c for c in places.columns if c not in ("__row", "seg")]
    lists = places.groupBy("__row", "seg").agg(F.collect_set(F.struct(*own)).alias("__xs"))
    both = parts.join(lists, ["__row", "seg"])
    one = lambda x: F.struct(*[x[c].alias(c) for c in own], *[f(x["i"]).alias(c) for c, f in more.items()])
    return both.select("__row", "seg", F.explode(F.transform("__xs", one)).alias("__x")).select("__row", "seg", "__x.*")


def _last(x: Column) -> Column:
    """The last run of other characters than spaces in a word; only groups of digits hold spaces."""
    return F.substring_index(x, " ", -1)


def key_of(pattern: str = "pattern") -> Column:
    """What tells cheaply where a pattern may stand: its label, or the end of the word before, told from the pattern."""
    rest = F.substring(pattern, 3, 1 << 30)
    before = F.when(F.col(pattern).startswith("3 "), F.substring_index(rest, " _ ", 1)).otherwise(rest)
    return F.when(F.col(pattern).startswith("= "), F.col(pattern)).otherwise(_last(before))


#: Bits of the filters for keys, patterns and values, in words of 64.
BITS = 1 << 17


def _bit(x: Column) -> Column:
    return F.hash(x).bitwiseAND(F.lit(BITS - 1))


def bits(values: DataFrame) -> DataFrame:
    """One row with an array of `BITS` bits, of which those of the values (one column) are set: as large whatever the input."""
    at = values.select(_bit(F.col(values.columns[0])).alias("b"))
    own = at.groupBy(F.shiftright("b", 6).cast("long").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("w"))
    all_ = values.sparkSession.range(BITS // 64).withColumnRenamed("id", "k").join(own, "k", "left")
    return all_.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"]).alias("bits"))


def _may_be(bits: str, x: Column) -> Column:
    """Whether a value may be among those of the bits; it always is if it's one of them."""
    b = _bit(x)
    return F.call_function("bit_get", F.get(bits, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1


def standing(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """__row, seg and pattern wherever one of the wanted patterns (one column) stands around anything in these segments. Few words pass the filter of keys, so that only for these patterns are made."""
    labels = wanted.agg(F.coalesce(F.max(F.col("pattern").startswith("= ")), F.lit(False)).alias("__labels"))
    both = bits(wanted.select(key_of().alias("key"))).withColumnRenamed("bits", "__kb").crossJoin(bits(wanted).withColumnRenamed("bits", "__pb")).crossJoin(labels)
    some = parts.select("__row", "seg", "c").crossJoin(F.broadcast(both))
    behind = F.array_compact(F.transform("c", lambda x, i: F.when(_may_be("__kb", _last(x)), i + 1)))
    own = F.array_compact(F.transform("c", lambda x, i: F.when((x.contains("=") | x.contains(":")) & _may_be("__kb", F.concat(F.lit("= "), F.regexp_extract(x, LABEL, 0))), i)))
    at = F.array_union(F.array_remove(behind, F.size("c")), F.when(F.col("__labels"), own).otherwise(F.array().cast("array<int>")))
    patterns = F.filter(F.flatten(F.transform(at, patterns_at)), lambda p: _may_be("__pb", p))
    return some.select("__row", "seg", F.explode(patterns).alias("pattern")).join(wanted, "pattern", "left_semi")


def _edges(parts: DataFrame, values: DataFrame) -> DataFrame:
    """value, kind, score and pattern wherever a pattern stands around one of the values (value, kind, score)."""
    some = parts.select("__row", "seg", "c", "w").crossJoin(F.broadcast(bits(values.select("value"))))
    # most words are values as they stand
    value = lambda i: F.when(_word(i).rlike(WRAPPED), _value(_word(i))).otherwise(_word(i))
    at = F.filter(_indexes(), lambda i: _may_be("bits", value(i)))
    one = F.transform(F.filter(at, lambda i: _plain(_word(i))), lambda i: F.struct(_value(_word(i)).alias("value"), patterns_at(i).alias("ps")))
    edges = some.select(F.explode(one).alias("x")).select("x.*").join(values, "value")
    return edges.select("value", "kind", "score", F.explode("ps").alias("pattern")).where("pattern is not null")


def _counts(places: DataFrame) -> DataFrame:
    return places.groupBy("pattern").agg(F.count("*").alias("n"))


def promising(mass: DataFrame, seeded: DataFrame) -> DataFrame:
    """The patterns of `mass` that may be confident: those that are so by their occurrences in segments with seeds, which are some of all."""
    low = _counts(standing(seeded, mass.select("pattern").distinct()))
    return mass.join(low, "pattern", "left").where(F.col("mass") / (F.coalesce("n", F.lit(0)) + 1) >= CONFIDENT).select("pattern").distinct()


def extract(seen: DataFrame) -> DataFrame:
    """Of rows with __row, __m and __seeds (whether masks are in it): __row and `added`, the spans that patterns add, as far as there are any."""
    spark = seen.sparkSession
    work = Scratch(spark, "contexts")
    seeded = work.save(segments(seen.where("__seeds")).where(F.col("part").rlike(MASK)).drop("part", "at"))
    # all other words are looked at only for patterns that may be confident
    everywhere = segments(seen)
    head = lambda i: F.when(_label(i) != "", _label(i)).otherwise(F.get("c", i - 1))
    at = F.filter(_indexes(), lambda i: F.get("c", i).contains("#") & _word(i).rlike(MASK))
    one = lambda i: F.struct(_kind(_word(i)).alias("kind"), F.regexp_extract(_word(i), f"[{CODES}]+", 0).alias("value"), patterns_at(i).alias("ps"))
    found = seeded.select(F.explode(F.transform(at, one)).alias("x")).select("x.kind", "x.value", F.explode("x.ps").alias("pattern"))
    seeds = found.where("pattern is not null").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("mass"), F.countDistinct("value").alias("support"))
    seeds = work.save(seeds)
    known = spark.range(0).select(F.lit("").alias("pattern"), F.col("id").alias("n"))
    places, values, accepted = [], None, None
    for k in range(ROUNDS):
        mass = seeds
        if values is not None:
            mass = mass.unionByName(_edges(everywhere, values).groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.countDistinct("value").alias("support")))
        mass = mass.groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"), F.sum("support").alias("support"))
        mass = work.save(mass.where(F.col("support") >= SUPPORT))
        # how often patterns with support stand around anything; each is counted once, and only if it may be confident
        new = work.save(promising(mass.join(known, "pattern", "left_anti"), seeded))
        if not new.isEmpty():
            places.append(work.save(standing(everywhere, new)))
            known = work.save(known.unionByName(_counts(places[-1])))
        sure = mass.join(known, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= CONFIDENT)
        sure = work.save(sure)
        if sure.isEmpty():
            break
        # the segments that hold such a pattern
        own = reduce(DataFrame.unionByName, places).join(sure.select("pattern").distinct(), "pattern", "left_semi")
        own = work.save(own.select("__row", "seg").distinct())
        near = segments(seen.join(own.select("__row").distinct(), "__row", "left_semi"))
        near = work.save(near.join(own, ["__row", "seg"], "left_semi").drop("part", "at"))
        around = F.transform(F.filter(_indexes(), lambda i: _plain(_word(i))), lambda i: F.struct(i.alias("i"), patterns_at(i).alias("ps")))
        hits = near.select("__row", "seg", F.explode(around).alias("x")).select("__row", "seg", "x.i", F.explode("x.ps").alias("pattern")).join(sure, "pattern")
        hits = hits.groupBy("__row", "seg", "i", "kind").agg(F.max("confidence").alias("confidence"))
        hits = work.save(_looked_up(near, hits, value=lambda i: _value(_word(i)), head=head).where("value <> ''"))
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = hits.groupBy("value", "kind", "head").agg(F.max("confidence").alias("confidence")).groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        enough = F.when(F.col("value").rlike(MARK), CONFIDENT).otherwise(PLAIN)
        scores = work.save(scores.where(F.col("score") >= enough))
        accepted = (hits, scores)
        if scores.isEmpty() or k == ROUNDS - 1:
            break
        values = scores
    if accepted is None:
        work.keep()
        return seen.select("__row", F.array().cast(SPANS).alias("added")).limit(0)
    hits, scores = accepted
    best = hits.join(scores, ["value", "kind"]).groupBy("__row", "seg", "i").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    # places are counted only in the segments that hold a span
    lists = work.save(best.groupBy("__row", "seg").agg(F.collect_set(F.struct("i", "kind")).alias("xs")))
    found = segments(seen.join(lists.select("__row").distinct(), "__row", "left_semi")).select("__row", "seg", "at", "part").join(lists, ["__row", "seg"])
    found = found.withColumn("__cut", cut(F.col("part"), ITEM)).withColumn("__items", matches("__cut"))

    def span(x: Column) -> Column:
        item = F.get("__items", x["i"])
        open_ = F.regexp_replace(F.regexp_replace(item["m"], LABEL, ""), OPEN, "")
        start = F.col("at") + item["e"] - F.length(open_)
        return F.struct(x["kind"].alias("kind"), start.alias("s"), (start + F.length(_value(item["m"]))).alias("e"))

    spans = found.select("__row", F.explode(F.transform("xs", span)).alias("x"))
    added = work.save(spans.groupBy("__row").agg(F.sort_array(F.collect_set("x")).alias("added")))
    work.keep(added)
    return added


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """For each row doc_id, __row (its key), the base spans as columns of their kinds, and `added`, the spans that the method adds."""
    work = Scratch(df.sparkSession, "pii")
    found = with_base_spans(df.select("doc_id", text), text)
    seeds = F.greatest(*[F.size(f"__{k}") for k in KINDS]) > 0
    seen = work.save(found.select("doc_id", row_key(text).alias("__row"), "__m", seeds.alias("__seeds"), *[base_spans(k).alias(k) for k in KINDS]))
    return seen.drop("__m", "__seeds").join(extract(seen), "__row", "left").withColumn("added", F.coalesce("added", F.array().cast(SPANS)))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def ordered(spans: Column) -> Column:
    """By kind as listed, then start."""
    keyed = F.transform(spans, lambda x: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


#: Texts with more spans are redacted in pieces of so many characters.
FEW, SHORT = 64, 1000


def _redacted(text: Column, spans: Column, begin: Column) -> Column:
    """A text that begins at a place of a whole one, with each span replaced by its kind in brackets where it starts."""
    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def add(acc: Column, x: Column) -> Column:
        kept = F.substring(text, acc["at"] - begin + 1, x["s"] - acc["at"])
        new = F.struct(x["e"].alias("at"), F.concat(acc["out"], kept, F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
        over = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["s"] >= acc["at"], new).otherwise(over)  # also of one that began before this text

    return F.aggregate(by_start, F.struct(begin.alias("at"), F.lit("").alias("out")), add, lambda a: F.concat(a["out"], F.substring(text, a["at"] - begin + 1, F.length(text))))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of `text` replaced by its kind in brackets; of overlapping spans the first counts, as far as they reach together."""
    work = Scratch(df.sparkSession, "pii")
    found = find(df, text).select("__row", F.concat(*KINDS, "added").alias("__spans")).where(F.size("__spans") > 0).dropDuplicates(["__row"])
    found = work.save(found)
    keyed = df.withColumn("__row", row_key(text))
    # long lists of spans are dealt over pieces of their text, so that no text is copied for each of its spans
    many = found.where(F.size("__spans") > FEW)
    texts = keyed.select("__row", F.col(text).alias("__text")).join(many.select("__row"), "__row").dropDuplicates(["__row"])
    pieces = texts.select("__row", F.posexplode(F.regexp_extract_all("__text", F.lit(f"(?s)(.{{1,{SHORT}}})"), F.lit(1))).alias("p", "piece"))
    spans = many.select("__row", F.explode("__spans").alias("x"))
    spans = spans.select("__row", "x", F.explode(F.sequence(F.expr(f"x.s div {SHORT}").cast("int"), F.expr(f"(x.e - 1) div {SHORT}").cast("int"))).alias("p"))
    spans = spans.groupBy("__row", "p").agg(F.collect_list("x").alias("xs"))
    clean = F.when(F.col("xs").isNotNull(), _redacted(F.col("piece"), F.col("xs"), F.col("p") * SHORT)).otherwise(F.col("piece"))
    done = pieces.join(spans, ["__row", "p"], "left").select("__row", "p", clean.alias("out")).groupBy("__row")
    done = done.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "out"))), lambda x: x["out"]), "").alias("__clean"))
    few = found.where(F.size("__spans") <= FEW).withColumn("__clean", F.lit(None).cast("string"))
    both = work.save(few.unionByName(done.withColumn("__spans", F.lit(None).cast(SPANS))))
    joined = keyed.join(both, "__row", "left")
    own = F.when(F.col("__spans").isNotNull(), _redacted(F.col(text), F.col("__spans"), F.lit(0))).otherwise(F.col(text))
    return joined.withColumn(text, F.coalesce("__clean", own)).select(*df.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.concat(*KINDS)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_string(base), 256).alias("base_sha256"),
        span_string(ordered(F.concat(base, "added"))).alias("spans"),
        F.size("added").alias("n_added"),
    )

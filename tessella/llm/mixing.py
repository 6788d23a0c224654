"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Raking scales the token weights of cells in turn until their
sums by source, by language and by topic meet the target shares; the factors a cell ends with are its documents'
calibrated weights. Documents are then kept by Bernoulli draws whose probabilities are proportional to these weights and
make up the wanted share of all tokens in expectation; a draw depends on doc_id alone.

Sources, languages and topics may be many: cells, targets and factors are tables, a round is one Spark job (each margin an
aggregation with map-side sums, joined back), and the driver sees one number a round. Rounds end once no factor changes by
more than `TOLERANCE`, after `rounds` at most; `rake` then says how far the margins still are from their targets (tempered
margins of thinly filled cells may contradict one another a little), and `mix` refuses a caller's targets that aren't met.

Targets default to tempered shares (a share to a power below one evens a margin out); a caller may give shares by value.
The topic of a document is by default its genre, told from its length and lines, a stand-in that needs no model; any column
may be given instead.

Defined results: null source, language or text count as ''; a text without words has no tokens, its document keeps the
weight of its cell; repeated rows weigh each time and are kept or dropped together; given targets count as shares of their
sum over the values that have tokens, values they don't name get none; an empty table gives an empty result; columns of the
input stay as they are (new ones replace those of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import SPACE, Scratch, literal_table, partitions, table, text_or_empty

ROUNDS, LEVELS, TOLERANCE = 30, 12, 1e-12
#: How far a margin may be from a target that a caller gives, as a share of all tokens.
MET = 1e-3
#: Cells that one task scales at most on average.
CELLS = 100_000
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}


def words_of(text: str = "text") -> Column:
    return F.filter(F.split(text_or_empty(text), SPACE), lambda w: w != "")


def default_topic(n_words: Column, text: str = "text") -> Column:
    """A genre: figures (over one character in ten is a digit), lines (below 12 words each), note, article or book by length."""
    t = text_or_empty(text)
    n = F.char_length(t)
    digits = n - F.char_length(F.translate(t, "0123456789", ""))
    lines = n - F.char_length(F.translate(t, "\n", "")) + 1
    by_length = F.when(n_words < 60, F.lit("note")).when(n_words < 600, F.lit("article")).otherwise(F.lit("book"))
    return F.when(10 * digits > n, F.lit("figures")).when((lines > 2) & (n_words < 12 * lines), F.lit("lines")).otherwise(by_length)


def draw(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """A number in [0, 1) that doc_id decides."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _goals(cells: DataFrame, margin: str, given: dict[str, float] | DataFrame | None) -> DataFrame:
    """(margin, goal): the share of all tokens that each value is to have."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("n"))
    if given is None:
        share = F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(TEMPER[margin]))).otherwise(0.0)
        shares = sums.select(margin, share.alias("share"))
    else:
        if isinstance(given, dict):
            given = literal_table(cells.sparkSession, list(given.items()), f"{margin} string, share double")
        own = given.groupBy(F.col(margin).alias("__of")).agg(F.sum("share").alias("share"))
        joined = sums.join(own, sums[margin] == own["__of"], "left")
        shares = joined.select(margin, F.when(F.col("n") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share"))
    whole = shares.agg(F.sum("share")).first()[0] or 1.0
    return shares.select(margin, (F.col("share") / F.lit(float(whole))).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | DataFrame] | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """Of cells (source, lang, topic, tokens): these with the column factor, under which tokens times factor meet the margins, and the greatest gap that is left.

    `targets` has, by margin, shares by value: a dict, or a table (margin, share)."""
    work, targets = Scratch(cells.sparkSession, "raking"), targets or {}
    if unknown := set(targets) - set(TEMPER):
        raise ValueError(f"no such margin: {sorted(unknown)}")
    state = cells.select(*TEMPER, "tokens", F.lit(1.0).alias("factor"))
    for m in TEMPER:
        state = state.join(_goals(cells, m, targets.get(m)).withColumnRenamed("goal", f"goal_{m}"), m)
    # tasks follow the number of cells: a few thousand are one task's work
    tasks = max(1, min(partitions(cells.sparkSession), cells.count() // CELLS))
    state = work.save(state.repartition(tasks, *TEMPER))

    def scaled(rows: DataFrame, margin: str) -> DataFrame:
        weight = F.sum(F.col("tokens") * F.col("factor"))
        if tasks == 1:  # no more than 2 * CELLS rows, which need not be read again for their sums
            joined = rows.withColumn("now", weight.over(W.partitionBy(margin)))
        else:
            joined = rows.join(rows.groupBy(margin).agg(weight.alias("now")), margin)
        return joined.withColumn("factor", F.when(F.col("now") > 0, F.col("factor") * F.col(f"goal_{margin}") / F.col("now")).otherwise(0.0)).drop("now")

    for _ in range(rounds):
        after = state.coalesce(tasks).withColumn("old", F.col("factor"))
        for m in TEMPER:
            after = scaled(after, m)
        change = F.when(F.col("old") > 0, F.abs(F.col("factor") / F.col("old") - 1)).otherwise(0.0)
        after = work.save(after.withColumn("change", change).drop("old"))
        work.drop(state)
        state = after.drop("change")
        state._tessella_at = after._tessella_at
        if (after.agg(F.max("change")).first()[0] or 0.0) <= TOLERANCE:
            break
    raked = work.save(scaled(state, "source"))
    gap = 0.0
    for m in TEMPER:
        now = raked.groupBy(m).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now"), F.first(f"goal_{m}").alias("goal"))
        gap = max(gap, now.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0)
    work.drop(state)
    return raked.select(*TEMPER, "tokens", "factor"), gap


def mix(df: DataFrame, keep_share: float = 0.7, text: str = "text", topic: Column | None = None, targets: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows of df (its columns `keep`, or all) with topic, n_tokens, weight (calibrated share of all tokens), keep_prob and kept.

    Raises ValueError if the targets contradict one another or can't be reached with the cells there are."""
    spark = df.sparkSession
    work = Scratch(spark, "mixing")
    own = [c for c in (df.columns if keep is None else keep) if c not in ("topic", "n_tokens", "weight", "keep_prob", "kept")]
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    made = df.withColumn("__n", F.size(words_of(text)).cast("long"))
    made = made.withColumn("__topic", plain(default_topic(F.col("__n"), text) if topic is None else topic))
    # saved: words are counted once, the cells and the draw read the counts
    made = work.save(made.select(*own, F.col("__n").alias("n_tokens"), F.col("__topic").alias("topic"), plain(F.col("source")).alias("__s"), plain(F.col("lang")).alias("__l")))
    cells = work.save(made.groupBy(F.col("__s").alias("source"), F.col("__l").alias("lang"), "topic").agg(F.sum("n_tokens").alias("tokens")))
    raked, gap = rake(cells, targets)
    if targets and gap > MET:
        raise ValueError(f"the targets can't be met: a margin is off by {gap:.3g} of all tokens")
    # probabilities min(1, level x factor): raise the level until the share of all tokens is met
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    level = 0.0
    for _ in range(LEVELS):
        r = raked.agg(F.sum(F.when(F.col("factor") * level >= 1, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(F.col("factor") * level >= 1, 0.0).otherwise(F.col("factor") * F.col("tokens"))).alias("rest")).first()
        if not r.rest:
            break
        level, last = max(0.0, (keep_share * total - r.full) / r.rest), level
        if abs(level - last) <= 1e-12 * level:
            break
    work.drop(cells)
    chance = raked.select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"), "factor", F.least(F.lit(1.0), F.col("factor") * level).alias("keep_prob"))
    done = made.join(chance, (made["__s"] == chance["__s"]) & (made["__l"] == chance["__l"]) & (made["topic"] == chance["__t"]))
    kept = draw() < F.col("keep_prob") if "doc_id" in own else F.lit(None).cast("boolean")
    return done.select(*[made[c] for c in own], made["topic"], "n_tokens", (F.col("n_tokens") * F.col("factor")).alias("weight"), "keep_prob", kept.alias("kept"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), keep=["doc_id", "source", "lang"])
    return done.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("keep_prob", 6).alias("keep_prob"), F.col("kept").cast("int").alias("kept"))


def op2_sql() -> str:
    """DuckDB SQL for op2_mixing: the rounds of raking written out."""
    w, k = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')", "tokens"
    topic = (
        "CASE WHEN 10 * (length(x) - length(translate(x, '0123456789', ''))) > length(x) THEN 'figures' WHEN lines > 2 AND n_tokens < 12 * lines THEN 'lines' "
        "WHEN n_tokens < 60 THEN 'note' WHEN n_tokens < 600 THEN 'article' ELSE 'book' END"
    )
    parts = [
        f"d AS (SELECT doc_id, source, lang, coalesce(source, '') s, coalesce(lang, '') l, coalesce(text, '') x, len({w}) n_tokens, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 lines FROM documents)",
        f"e AS (SELECT doc_id, source, lang, s, l, n_tokens, {topic} t FROM d)",
        f"c0 AS (SELECT s, l, t, sum(n_tokens)::DOUBLE {k} FROM e GROUP BY ALL)",
    ]
    for name, col in (("source", "s"), ("lang", "l"), ("topic", "t")):
        share = f"(sum({k}) / (SELECT sum({k}) FROM c0)) ** {TEMPER[name]}"
        parts.append(f"g{col} AS MATERIALIZED (SELECT {col}, CASE WHEN sum({k}) > 0 THEN {share} ELSE 0 END / (SELECT sum(x) FROM (SELECT CASE WHEN sum({k}) > 0 THEN {share} ELSE 0 END x FROM c0 GROUP BY {col})) g FROM c0 GROUP BY {col})")
    parts.append("r0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE f FROM c0)")
    n = 0
    for col in [*"slt"] * ROUNDS + ["s"]:
        sum_ = f"sum({k} * f) OVER (PARTITION BY {col})"
        parts.append(f"r{n + 1} AS MATERIALIZED (SELECT r.s, r.l, r.t, {k}, CASE WHEN {sum_} > 0 THEN f * g / {sum_} ELSE 0 END f FROM r{n} r JOIN g{col} USING ({col}))")
        n += 1
    parts.append(f"v0 AS MATERIALIZED (SELECT 0.0::DOUBLE v, (SELECT sum({k}) FROM c0) n)")
    for i in range(LEVELS):
        parts.append(f"v{i + 1} AS MATERIALIZED (SELECT CASE WHEN rest > 0 THEN greatest(0, (0.7 * n - full_) / rest) ELSE v END v, n FROM (SELECT max(v) v, max(n) n, sum(CASE WHEN f * v >= 1 THEN {k} ELSE 0 END) full_, sum(CASE WHEN f * v >= 1 THEN 0 ELSE f * {k} END) rest FROM r{n}, v{i}))")
    parts.append(f"p AS (SELECT s, l, t, f, least(1.0, f * v) q FROM r{n}, v{LEVELS})")
    draw_ = "('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, t AS topic, n_tokens, round(n_tokens * f, 9) AS weight, round(q, 6) AS keep_prob, CASE WHEN {draw_} < q THEN 1 ELSE 0 END::INTEGER AS kept FROM e JOIN p USING (s, l, t)"

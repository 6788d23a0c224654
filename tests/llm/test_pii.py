import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tessella.llm import pii


def base(t):
    """Spans by the patterns as they are written in the contract."""
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c in "0123456789"][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def line(found):
    return ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in found[k])


def test_query_equals_patterns(spark, small, docs):
    got = {r.doc_id: r for r in pii.op4_pii(spark, small).collect()}
    for i, t in docs:
        found = base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(line(found).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(found[k]) for k in pii.KINDS]
        assert set(line(found).split(",")) <= {*got[i].spans.split(","), ""}


def test_random_texts(spark):
    random.seed(1)
    bits = ["1", "2", "55", ".", " ", "-", "@", "a", "_", "+", "%", "é", "(", ")", "x.y", "4111111111111111", "😀", "\n", "+1 (988) 555-2485", "a@b.c", "1.2.3.4", "", "300", "  ", "٣", "000255"]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 40)))) for i in range(800)]
    rows += [(9000 + i, t) for i, t in enumerate(["9" * 10_000, "1 " * 10_000, "a." * 10_000 + "@b.c", "a" * 10_000, "x@" + "a." * 10_000 + "b", "+1" + " " * 10_000, "1." * 10_000, "." * 10_000 + "1"])]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.b for r in found.select("doc_id", pii.span_string(F.concat(*pii.KINDS)).alias("b")).collect()}
    assert got == {i: line(base(t)) for i, t in rows}


SEEDS = [(i, f"please write contactmail a{i}@b{i}.org now") for i in range(8)]


def test_context_finds_what_patterns_miss(spark):
    rows = [*SEEDS, (100, "please write contactmail bob77(at)x.org, now"), (101, "room 77 is free"), (102, "now 55 things")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: pii_spans for r in pii.find(df).collect() if (pii_spans := [tuple(x) for x in r.added])}
    assert got == {100: [("email", 25, 39)]}
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[100] == "please write contactmail [EMAIL], now"
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[3] == "please write contactmail [EMAIL] now"


def test_common_words_are_no_patterns(spark):
    """A word that also stands before ordinary words, or before one value only, adds nothing."""
    rows = [(i, f"see the a{i}@b{i}.org or the house and the tree") for i in range(8)] + [(50, "the 99x")]
    rows += [(60 + i, "only same@b.org") for i in range(8)] + [(90, "only 7z")]
    assert pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(added) > 0").count() == 0


def test_new_seeds_induce_new_patterns(spark):
    """Values found behind a first pattern make a second one, which finds a value that the first never precedes."""
    rows = [*SEEDS, *[(20 + i, f"contactmail u{i}(at)x.org and reachme u{i}(at)x.org") for i in range(5)], (50, "reachme z9(at)y.org")]
    got = {r.doc_id for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(added) > 0").collect()}
    assert got == {20, 21, 22, 23, 24, 50}


def test_labels_are_patterns(spark):
    rows = [(i, f"x tel=+1 555 000 {1000 + i} y") for i in range(6)] + [(9, "x tel=5550001234 y")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(added) > 0").collect()
    assert [(r.doc_id, [tuple(x) for x in r.added]) for r in got] == [(9, [("phone", 6, 16)])]


def test_odd_rows(spark, odd, nothing):
    assert pii.find(odd).count() == odd.count()
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    assert pii.find(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_overlapping_spans_are_redacted_once(spark):
    df = spark.createDataFrame([(1, "call +4111111111111111 or 4111 1111 1111 1111 ok")], "doc_id long, text string")
    text = pii.redact(df).first().text
    assert "4111" not in text and text.endswith(" ok")


NAMES = ["anna", "bert", "cora", "dirk", "elsa", "fred"]


def added(spark, texts):
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("size(added) > 0")
    return {r.doc_id: [(x.kind, texts[r.doc_id][x.s : x.e]) for x in r.added] for r in found.collect()}


def test_seeds_and_identifiers_without_digits(spark):
    texts = [f"write contactmail {n}@example.com now" for n in NAMES] + ["write contactmail gina(at)example.com, now"]
    assert added(spark, texts) == {6: [("email", "gina(at)example.com")]}


def test_added_spans_hold_all_digit_groups(spark):
    texts = [f"x tel=+1 555 000 {1000 + i} y" for i in range(6)] + ["x tel=030 1234 5678, or 9 y"]
    assert added(spark, texts) == {6: [("phone", "030 1234 5678")]}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[6] == "x tel=[PHONE], or 9 y"


def test_pattern_words_may_hold_digits(spark):
    texts = [f"at ipv4 10.0.0.{i} up" for i in range(6)] + ["at ipv4 10-0-0-77 up"]
    assert added(spark, texts) == {6: [("ip", "10-0-0-77")]}


def test_recall_of_planted_identifiers(spark):
    """Unseen identifiers (written out, without digits) behind one word, two words or between two: most are found, and ordinary words aren't."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    ways = ["mailto {}", "write to {}", "from {} sent"]
    rows, planted = [], {}
    for i in range(240):
        way = ways[i % 3]
        if i % 8 == 7:
            value = rng.choice([f"{word()}(at){word()}.org", f"user{word()}"])
            text = f"{prose(12)} {way.format(value)} {prose(9)}"
            planted[i] = (text.index(value), text.index(value) + len(value))
        else:
            text = f"{prose(12)} {way.format(f'{word()}{i}@{word()}.com')} {prose(9)}"
        rows.append((i, text))
    rows += [(1000 + i, f"{prose(8)} to {prose(5)} from {prose(3)}") for i in range(200)]
    got = {r.doc_id: {(x.s, x.e) for x in r.added} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(span in got[i] for i, span in planted.items())
    wrong = sum(len(v - {planted.get(i)}) for i, v in got.items())
    assert hit >= 0.9 * len(planted) and wrong <= 0.05 * len(planted)


def test_contexts_stay_within_segments(spark, monkeypatch):
    """Places of added spans are right in any segment of a long text."""
    monkeypatch.setattr(pii, "SEGMENT", 50)
    filler = "é word " * 40
    rows = [*SEEDS, (100, f"{filler}contactmail bob(at)x.org {filler}contactmail al(at)y.org, {filler}")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 100").first().added
    assert {rows[-1][1][x.s : x.e] for x in got} <= {"bob(at)x.org", "al(at)y.org"} and got


def test_many_spans_in_one_text(spark):
    """Pieces give what a single pass gives; 100,000 spans in a text of ten million characters take seconds, not hours."""
    rng = random.Random(5)
    text = " ".join(rng.choice(["é", "x" * rng.randint(1, 3000), f"a{i}@b.org", f"+4111{rng.randint(10**11, 10**12 - 1)}", "4111 1111 1111 1111"]) for i in range(600))
    df = spark.createDataFrame([(1, text), (2, text[:90]), (1, text)], "doc_id long, text string")
    found = base(text)
    clean, at = "", 0
    for a, b, k in sorted((a, b, k) for k, v in found.items() for a, b in v):
        if a >= at:
            clean += text[at:a] + f"[{k.upper()}]"
        at = max(at, b)
    got = [r.text for r in pii.redact(df).where("doc_id = 1").collect()]
    assert got == [clean + text[at:]] * 2
    big = " ".join(f"{'é' * 90} a{i}@b{i}.org" for i in range(100_000))
    began = time.time()
    row = pii.redact(spark.createDataFrame([(1, big)], "doc_id long, text string")).first()
    assert row.text == " ".join([f"{'é' * 90} [EMAIL]"] * 100_000) and time.time() - began < 120


def test_segments_hold_a_text_once(spark):
    """Words are kept beside their lower-cased form only where they differ from it."""
    rows = [(1, "plain words stay as they are, Names don't; mail ann@x.org or call 030 1234 5678.")]
    seen = pii.with_base_spans(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("__row", F.lit(b"1"))
    got = pii.segments(seen).select("w", "c", F.transform(pii._indexes(), pii._word).alias("words")).first()
    assert [w for w in got.w if w is not None] == [w for w, c in zip(got.words, got.c, strict=True) if w != c] and len([w for w in got.w if w]) == 2
    assert got.words[0] == "plain" and got.words[6] == "Names" and "#" in got.c[9]


def test_words_are_the_items(spark):
    """Texts parted at white space give what the pattern of items finds."""
    rng = random.Random(7)
    bits = ["12", "(030)", "a", "Tel:", "x=", " ", "  ", "\n", "\x0b", "\t", "\r", "\x0c", "é", ",", "/", "-", " ", "\x85", "#", "+"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(1500)] + [(-1, ""), (-2, " "), (-3, " a ")]
    df = spark.createDataFrame(rows, "id long, t string").select(pii.words(F.col("t")).alias("x"), F.regexp_extract_all("t", F.lit(f"({pii.ITEM})"), F.lit(1)).alias("y"))
    assert df.where("x <> y or x is null").count() == 0 and df.where("size(x) > 1 and exists(x, v -> v like '% %')").count() > 0


def test_patterns_stand_where_words_say(spark, monkeypatch):
    """Few bits let more words pass, and change no count."""
    rng = random.Random(8)
    bits = ["the", "of", "_", "x", "mail:", "tel=5", "12 34", "34", "key=", "=", "a:b", "#"]
    rows = [(i, "  ".join(rng.choices(bits, k=rng.randint(0, 9)))) for i in range(400)]
    seen = spark.createDataFrame(rows, "id long, __m string").withColumn("__row", F.col("id").cast("string").cast("binary"))
    parts = pii.segments(seen)
    every = parts.select("__row", "seg", F.explode(F.flatten(F.transform(pii._indexes(), pii.patterns_at))).alias("pattern")).where("pattern is not null")
    expected = sorted((r.pattern, bytes(r["__row"])) for r in every.collect())
    asked = sorted({p for p, _ in expected})
    for size, some in ((64, asked), (1 << 17, asked[::3]), (1 << 17, [p for p in asked if p[0] != "="][:5])):
        monkeypatch.setattr(pii, "BITS", size)
        got = pii.standing(parts, spark.createDataFrame([(p,) for p in some], "pattern string"))
        assert sorted((r.pattern, bytes(r["__row"])) for r in got.collect()) == [x for x in expected if x[0] in set(some)]


def test_only_segments_with_seeds_are_kept(spark, monkeypatch):
    """Where no pattern can be confident by the segments with seeds, the words of other texts are neither written nor counted."""
    rows = [(i, f"see the a{i}@b{i}.org or the house and the tree") for i in range(8)] + [(100 + i, "the house of the tree") for i in range(50)]
    saved, save = [], pii.Scratch.save

    def noted(self, df, *by):
        out = save(self, df, *by)
        saved.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(pii.Scratch, "save", noted)
    assert pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(added) > 0").count() == 0
    assert max(n for columns, n in saved if "c" in columns) == 8

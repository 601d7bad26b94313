import math
import zlib

from oracle import same
from pyspark.sql import functions as F

from brute_templates import held_items
from tidemark.llm import decontamination, langid, linededup, pii, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)


def component(links, ids):
    """Smallest id reachable from each place."""
    out = []
    for i in range(len(ids)):
        seen, stack = {i}, [i]
        while stack:
            for j in links(stack.pop()):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        out.append(min((ids[j] for j in seen if ids[j] is not None), default=None))
    return out


# op2


def brute_lines(rows):
    """Passages in order of id; rows with distinct ids."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            run = tuple(lines[i : i + 3])
            if any(x.strip(" ") for x in run):
                gone |= {i, i + 1, i + 2} if run in seen else set()
                seen.add(run)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    rows = [(3, "a\nb\nc\nd"), (1, "x\na\nb\nc"), (2, "a\nb\nc"), (4, "a\nb"), (5, ""), (6, "\n\n\n\n"), (7, "\n\n\n"), (8, "r\nr\nr\nr\nr"), (9, "b\nc\nd\ne\nz"), (10, "a\nb\r\nc")]
    got = linededup.remove_repeats(table(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in got}[2] == (3, 3)


def test_line_dedup_of_odd_rows(spark):
    rows = [(None, "a\nb\nc"), (1, None), (1, "a\nb\nc"), (1, "a\nb\nc"), (1, "q")]
    df = table(spark, rows).withColumns({"n_lines": F.lit("own"), "text_mark": F.lit(1), "covered": F.lit(2)})
    out = linededup.remove_repeats(df, removed_out="gone")
    assert [c for c in out.columns if c not in ("n_lines", "gone")] == [c for c in df.columns if c != "n_lines"]
    assert sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, [(None, "a\nb\nc"), (1, None), (1, ""), (1, ""), (1, "q")]))
    assert linededup.remove_repeats(table(spark, []).limit(0)).count() == 0


def test_line_dedup_of_a_hot_passage(spark):
    rows = [(i, f"common\nlines\nhere\nown {i}") for i in range(3000)]
    got = {r.doc_id: r.text for r in linededup.remove_repeats(table(spark, rows)).collect()}
    assert got[0].startswith("common") and all(got[i] == f"own {i}" for i in range(1, 3000))


def test_line_dedup_of_very_many_lines(spark):
    """Texts are cut into lines once: ten times the lines take about ten times as long, not a hundred times."""
    import time

    took = []
    for n in (16_000, 160_000):
        text = "\n".join(f"line {i} of this text" for i in range(n))
        begin = time.time()
        got = {r.doc_id: r.text for r in linededup.remove_repeats(table(spark, [(1, text), (2, f"first\n{text}\nlast")])).collect()}
        took.append(time.time() - begin)
        assert got == {1: text, 2: "first\nlast"}
    assert took[1] < 20 * took[0] + 5


def test_line_dedup_equals_its_sql(spark, sf_dir):
    same(spark, sf_dir, queries.op2_line_dedup, linededup.ORACLE_SQL)


# op4


def test_languages_are_told(spark, sf_dir):
    rows = queries.op4_language_id(spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def slow_buckets(text):
    """n-grams of a text, one by one, with plain integers."""
    import unicodedata

    said = []
    for i, c in enumerate(text.lower()):
        if unicodedata.category(c)[0] in "LM":
            said.append(ord(c))
        elif i == 0 or said[-1:] != [32]:
            said.append(32)
    out = []
    for n in (1, 2, 3):
        for i in range(len(said) - n + 1):
            h = 0
            for k in range(n):
                h = (h + said[i + k]) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[k] % (1 << 32)
                h ^= h >> 15
            out.append((h >> 7) % (1 << 16))
    return sorted(out)


def test_grams_equal_brute_force(monkeypatch):
    texts = ["", "a", "Ab – cd", "  x", "«ÉÀ»!!  z", "ΟΔΟΣ ΣΑΣ", "नमस्ते 12", "ab" * 50, "x y " * 40, "!?"]
    for block in (1 << 20, 7, 3):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = {}
        for buckets, owner in langid.batch_grams(texts):
            for b, o in zip(buckets.tolist(), owner.tolist()):
                got.setdefault(o, []).append(b)
        assert {i: sorted(v) for i, v in got.items()} == {i: slow_buckets(t) for i, t in enumerate(texts) if t}


def test_bayes_equals_brute_force(spark):
    rows = [("abab aba", "x"), ("cdcd cdd", "y"), ("abcd", "x"), (None, "x"), ("zzz", None), ("", "y"), ("", "w")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ("x", "y")
    counts = {"x": {}, "y": {}}
    for text, lang in rows:
        if text and lang:
            for b in slow_buckets(text):
                counts[lang][b] = counts[lang].get(b, 0) + 1
    n = {k: sum(v.values()) for k, v in counts.items()}
    texts = ["abba", "dcd", "ab cd", "É", None, "12"]
    said, p, fit = model.predict_all(texts)
    assert fit[1] > 0 > fit[3] and model.predict_all(["王小明"])[2][0] < 0
    for i, text in enumerate(texts[:4]):
        score = {k: math.log(n[k] / sum(n.values())) + sum(math.log((counts[k].get(b, 0) + 0.5) / (n[k] + 0.5 * langid.BUCKETS)) for b in slow_buckets(text)) for k in counts}
        assert said[i] == max(score, key=score.get) and abs(p[i] - 1 / sum(math.exp(v - max(score.values())) for v in score.values())) < 1e-4
        assert model.predict(text) == (said[i], p[i])
    assert said[4:] == ["und", "und"] and p[4:].tolist() == [0, 0]


def test_too_many_languages(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([("abc", f"l{i}") for i in range(4)], "text string, lang string"))


def test_languages_of_odd_rows(spark):
    model = langid.train(spark.createDataFrame([("hello there", "en"), ("bonjour là", "fr")], "text string, lang string"))
    df = table(spark, [(1, None), (1, ""), (None, "123 ... !"), (2, "hello " * 400_000), (2, "hello")])
    got = langid.identify(df.withColumn("score", F.lit("own")), model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "und"), ("1", "und"), ("2", "en"), ("2", "en"), ("None", "und")]
    none = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert none.predict("hello") == ("und", 0.0)
    assert langid.identify(df.limit(0), none).count() == 0


# op8


def brute_simhash(rows):
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    ids = [d for d, _ in rows]
    near = lambda i: [j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2]
    return sorted(map(str, zip(ids, (f"{f:016x}" for f in fps), component(near, ids))))


def slow_fingerprint(text):
    import re

    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    for text in ("", "One", "Two words", "ÀÉ Same SAME same a b c d\x0b\x1c e", "the cat sat on the mat " * 9):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_simhash_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(None, rows[0][1]), (900, None), (901, " "), (902, rows[3][1]), (902, rows[3][1]), (903, rows[5][1] + " more")]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert sorted(map(str, [(r.doc_id, r.fingerprint, r.component_id) for r in got])) == brute_simhash(rows)
    assert simhash.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_every_pair_within_two_bits_shares_a_cell(spark):
    import random

    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for f in list(fps):
        for n in (1, 2, 2, 3):
            for _ in range(n):
                f ^= 1 << r.randrange(64)
            fps.append(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    found = spark.createDataFrame([(f,) for f in signed], "fp long").select("fp", simhash.cells(simhash.counts_key(F.col("fp"))).alias("c")).collect()
    cells = {x.fp: set(x.c) for x in found}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                assert cells[a] & cells[b]


def test_large_cells_are_linked_alike(monkeypatch):
    import random

    import numpy as np

    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for _ in range(5):
            f ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.append(f)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    monkeypatch.setattr(simhash, "DENSE", 0)
    ids = fps.tolist()
    links = {}
    for a, b in simhash.link_cell(fps, 0):
        links.setdefault(ids.index(a), []).append(ids.index(b))
        links.setdefault(ids.index(b), []).append(ids.index(a))
    near = lambda i: [j for j in range(len(ids)) if (ids[i] ^ ids[j]).bit_count() <= 2]
    assert component(lambda i: links.get(i, []), ids) == component(near, ids)


# op9


def test_surrogates(spark):
    rows = [
        (1, "Mrs. Smith-Jones met Mr Brown and Mrs Smith-Jones; mail a.B7@mail.Example.com, ip 10.0.0.255 card 4532015112830366 tel +1 (651) 555-8500."),
        (2, "Mr Brown, again Ms Brown"),
        (None, 'г-н Иванов token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! ssn 123-45-6789'),
        (3, None), (3, ""), (2, "Mr Brown, again Ms Brown"), (4, "nothing here but 12 and a@b"), (5, "x " * 50_000 + "a.B7@mail.Example.com"),
    ]
    df = table(spark, rows).withColumn("n_entities", F.lit("own"))
    got = pii.replace_entities(df, key="k").collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_entities): r.text for r in got}
    text = by[1, 7]
    assert "Smith" not in text and "Brown" not in text and "555-8500" not in text and "+1 (" in text
    woman = text.split("Mrs. ")[1].split(" met")[0]
    assert text.count(woman) == 2 and "-" in woman and woman.split("-")[0].endswith("a")
    man = text.split("Mr ")[1].split(" and")[0]
    assert by[2, 2].startswith(f"Mr {man}, again Ms ") and not by[2, 2].endswith(man)
    mail = text.split("mail ")[1].split(",")[0]
    assert mail.endswith(".com") and len(mail) == len("a.B7@mail.Example.com") and by[5, 1].endswith(mail)
    card = text.split("card ")[1].split(" ")[0]
    digits = [int(c) for c in reversed(card)]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0 and card != "4532015112830366"
    assert all(0 < int(x) < 256 for x in text.split("ip ")[1].split(" ")[0].split("."))
    assert by[4, 0] == rows[6][1] and by[3, 0] in (None, "")
    other = {r.doc_id: r.text for r in pii.replace_entities(df, key="other").collect()}
    assert other[1] != text
    assert pii.replace_entities(df.limit(0), key="k").count() == 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    """With 10 x 10 possible surrogates for 60 entities there are collisions; each is solved."""
    monkeypatch.setattr(pii, "ATTEMPTS", 60)
    entities = spark.createDataFrame([("ssn", f"{i:02d}", 1) for i in range(60)], "kind string, core string, n long")
    made = {r.core: r.surrogate for r in pii.assign(entities.where("core < '30'"), "k").collect()}
    assert len(made) == 30 == len(set(made.values())) and not set(made) & set(made.values())


# op10

BENCH = [(7, "Yesterday Alice bought 3 kg of apples and then Bob gave Alice 5 more apples for the pie they made"), (8, None), (9, "short one"), (10, "what is the total length of the fence around the square field near the river")]


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = [
        (1, BENCH[0][1]),
        (2, "hmm. Yesterday Carol bought 7 kg of apples and then Dave gave Carol 9 more apples for the pie they made. yes"),
        (3, "Yesterday Carol bought 7 kg of apples and then Dave gave Eve 9 more apples for the pie they made"),
        (4, None), (5, ""), (5, "x"), (None, "A: WHAT IS THE TOTAL LENGTH OF THE FENCE AROUND THE SQUARE FIELD NEAR THE RIVER!!"),
        (6, "what is the total length of"), (6, BENCH[3][1] + " tail " * 30_000),
    ]
    df = table(spark, rows).withColumn("said", F.lit(1))
    got = sorted(map(str, [(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench).collect()]))
    assert got == sorted(map(str, [(1, 7), (2, 7), (3, None), (4, None), (5, None), (5, None), (None, 10), (6, None), (6, 10)]))
    assert decontamination.find_leaks(df, bench.limit(0)).where("item_id IS NOT NULL").count() == 0
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0


def leaks(spark, texts, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.item_id, r.coverage) for r in decontamination.find_leaks(df, bench).collect()}


def test_decontamination_equals_brute_force(spark, sf_dir):
    import random

    r = random.Random(6)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(8).collect()] + BENCH + [(20, "What is 12 + 5?"), (21, "Natalia sold 48 clips. Natalia then bought 5 kg of rice. Natalia paid $7 in May."), (22, "Paris"), (23, "How far is Rome?"), (24, "")]
    texts = [x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for _, t in items:
        if not t:
            continue
        w = t.split()
        texts += [t, f"so. {t} end", t.upper(), t.lower(), t.title(), " ".join(x.strip(".,?") for x in w), " ".join(w[: len(w) // 2]), " ".join(w[: len(w) // 2] + ["inserted", "words"] + w[len(w) // 2 :])]
        for _ in range(4):
            texts.append(" ".join(r.choice(["7", "8.5", "Marcus", "Eve", "pears"]) if r.random() < 0.2 and (x[0].isupper() or x[0].isdigit()) else x for x in w))
    got = leaks(spark, texts, items)
    for i, text in enumerate(texts):
        best = held_items(text, items)
        assert got[i][0] == (best[0][1] if best else None) and (not best or abs(got[i][1] - best[0][0]) < 1e-9), (text, got[i], best[:2])
    assert sum(x[0] is not None for x in got.values()) > 80


def test_questions_that_templates_used_to_miss(spark):
    items = [(1, "What is 12 + 5?"), (2, "Natalia sold 48 clips to her friends. Natalia then bought 5 kg of rice. Natalia paid for it in cash."), (3, "Alice gave Bob 3 apples and then Bob gave Carol 2 pears for lunch")]
    texts = ["he asked: What is 12 + 5? and left", "what is 99 + 1", "Marcus sold 31 clips to her friends. Marcus then bought 9kg of rice. Marcus paid for it in cash.", "natalia sold 48 clips to her friends natalia then bought 5 kg of rice natalia paid for it in cash", "NATALIA SOLD 48 CLIPS TO HER FRIENDS. NATALIA THEN BOUGHT 5 KG OF RICE. NATALIA PAID FOR IT IN CASH.", "so Dan gave Eve 7 apples and then Eve gave Fay 9 pears for lunch", "so Dan gave Dan 7 apples and then Dan gave Dan 9 pears for lunch", "Marcus sold 31 clips to her friends. Lukas then bought 9kg of rice. Petra paid for it in cash."]
    assert {i: x for i, (x, _) in leaks(spark, texts, items).items()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 3, 6: None, 7: None}

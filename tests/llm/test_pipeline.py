import random

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from brute_templates import held_items
from tidemark.llm import langid, simhash
from tidemark.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINES = ["the first of the common lines is this one here", "the second of the common lines is that one there", "the third of the common lines ends the passage"]


def own(spark, sf_dir):
    """Documents of the test tables, and cases: no letter, null, a repeated passage, copies, a benchmark item."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    text = "\n".join([f"words of their own stand in this text at place {i} of many" for i in range(2)])
    more = [(9000, None), (9001, "12 34 !"), (9002, "\n".join(["an opening line of its own with words", *LINES])), (9003, "\n".join([*LINES, "another end that nothing else has in it"])), (9004, text), (9005, text), (9005, text), (9006, f"It was said. {item} And so on."), (9007, "\n".join(LINES)), (9008, "это текст на языке, которого модель не знает, и в нём нет ничего другого")]
    return spark.createDataFrame(docs + [(d, t, "en", "s", len(t or "")) for d, t in more], DOCS)


def test_stages_equal_brute_force(spark, sf_dir):
    docs = own(spark, sf_dir)
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "pack"]

    told = stages["language"](spark, docs, sf_dir).collect()
    assert told[0].asDict().keys() == docs.first().asDict().keys()
    model = langid.train(docs.where((langid.fold(docs.doc_id) != 1) | docs.doc_id.isNull()))
    rows = docs.collect()
    said, score, fit = model.predict_all([r.text for r in rows])
    expected = [(r.doc_id, x) for r, x, p, f in zip(rows, said, score, fit) if x != "und" and p >= 0.5 and f >= 0]
    assert sorted((r.doc_id, r.lang) for r in told) == sorted(expected) and not {9000, 9001, 9008} & {d for d, _ in expected} and {r.doc_id for r in rows if r.doc_id < 9000} <= {d for d, _ in expected}

    lined = stages["line_dedup"](spark, spark.createDataFrame(told, DOCS), sf_dir).collect()
    by = {r.doc_id: r.text for r in lined}
    assert by[9002].endswith(LINES[2]) and by[9003] == "another end that nothing else has in it" and 9007 not in by
    assert all(r.n_chars == len(r.text) for r in lined)

    near = stages["near_dedup"](spark, spark.createDataFrame(lined, DOCS), sf_dir).collect()
    rows = sorted({(r.doc_id, r.text) for r in lined})
    groups = five_word_groups([t for _, t in rows])  # the general rule: five words, similarity 0.8
    assert sorted(r.doc_id for r in near) == sorted(rows[i][0] for i in set(groups)) and 9004 in {r.doc_id for r in near} and 9005 not in {r.doc_id for r in near}

    clean = stages["decontaminate"](spark, spark.createDataFrame(near, DOCS), sf_dir).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in near if not held_items(r.text, items))
    assert 9006 not in {r.doc_id for r in clean}

    packed = stages["pack"](spark, spark.createDataFrame(clean, DOCS), sf_dir).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert sum(p.length for p in packed) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean)


def five_word_groups(texts):
    """Smallest place of each text's group, compared pair by pair."""
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_dedup_finds_copies_of_similarity_four_fifths(spark, sf_dir):
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(base)]
    for n in (1, 2, 2, 3, 4) * 30:  # near copies of one text, over and under the limit, more than are common
        words = list(base)
        for at in rng.sample(range(120), n):
            words[at] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(words))
    texts += [" ".join([f"v{rng.randrange(9999)}" for _ in range(60)] + passage) for _ in range(150)]  # share a passage only
    texts += [" ".join(f"c{i}" for i in range(n)) for n in (20, 21, 24, 29, 40, 49)]  # chains
    texts += ["one two", "One two", "", "  "]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    root = five_word_groups(texts)
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root)) and len(set(root)) < len(texts) - 50
    own = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    root = five_word_groups([r.text or "" for r in own])
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(own, DOCS), sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(own[i].doc_id for i in set(root))


def test_near_dedup_compares_few_of_a_group_below_the_limit(spark, sf_dir, monkeypatch):
    """Texts of one origin, nearly all of them below the limit to one another: the sets of pairs that can't be near aren't fetched, and no group is lost."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((2, 3, 3, 4))):
            words[at] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(words))
    made, kept = {}, simhash.stored

    def noted(df, name="table"):
        made[name] = kept(df, name)
        return made[name]

    monkeypatch.setattr(simhash, "stored", noted)
    root = five_word_groups(texts)
    told = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in told} == dict(enumerate(root)) and 3 < len(set(root)) < 297
    assert made["split_classes"].select("sig").distinct().count() > 100 and made["open_pairs"].count() < 900


def test_no_near_sets_are_left_out(spark):
    """At any size, folded or not: sets of similarity 0.8 pass, and most of those below 0.7 don't."""
    rng = np.random.default_rng(2)
    rows = []
    for n in (0, 1, 4, 5, 8, 9, 16, 17, 20, 64, 100, 128, 129, 130, 256, 257, 260, 900, 1024, 1025, 1100, 5000):
        for more in (0, 1, n // 9, n // 8, n // 5, n // 4, n // 2):
            for swapped in (0, 1, n // 20, n // 10, n // 9, n // 8, n // 5):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                b = np.unique(np.concatenate([a[min(swapped, n) :], rng.integers(0, 1 << 63, min(swapped, n) + more, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                rows.append((len(a), simhash.parity(a).tolist(), len(b), simhash.parity(b).tolist(), both / max(1, len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "n int, p array<long>, m int, q array<long>, similarity double")
    said = [(r.similarity, r.a, r.b, r.n) for r in df.select("similarity", "n", simhash.may_be_near(df.n, df.p, df.m, df.q).alias("a"), simhash.may_be_near(df.m, df.q, df.n, df.p).alias("b")).collect()]
    assert all(a and b for s, a, b, _ in said if s >= 0.8) and sum(s >= 0.8 for s, *_ in said) > 100
    far = [bool(a) for s, a, _, n in said if s < 0.7 and 16 < n < 1500]
    assert len(far) > 100 and sum(far) < len(far) / 20


def test_repeated_rows_leave_one(spark, sf_dir):
    rows = [(1, "a b c d e", "en", "s", 9)] * 3 + [(None, "other words entirely here", None, None, None)] * 2
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect()
    assert sorted(map(str, [r.doc_id for r in got])) == ["1", "None"]


def test_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_the_whole(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096

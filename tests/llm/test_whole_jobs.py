"""Near-duplicate groups against brute force over whole shingle sets; what the pipeline's stages drop and keep."""

import random

from parley.llm import simhash

WORDS = [f"w{i}" for i in range(4000)]


def edited(r, words, times):
    """The words with ``times`` of them replaced, far enough apart that each changes five shingles of its own."""
    out = words[:]
    for at in r.sample(range(5, len(words) - 5, 6), times):
        out[at] = r.choice(WORDS) + "x"
    return out


def shingled(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = (x if isinstance(x, set) else shingled(x) for x in (a, b))
    return len(a & b) / len(a | b)


def components(texts, among):
    label, texts = {i: i for i in texts}, {i: shingled(t) for i, t in texts.items()}
    for i, j in among:
        if label[i] != label[j] and similarity(texts[i], texts[j]) >= 0.8:
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    return label


def groups(spark, texts):
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    return {x.doc_id: x.component_id for x in simhash.similar_groups(rows).collect()}


def test_similar_groups_follow_chains(spark):
    r, texts, among = random.Random(11), {}, []
    for n in range(25):  # each link is over 0.8, the ends are not alike
        chain = [r.choices(WORDS, k=100)]
        for _ in range(3):
            chain.append(edited(r, chain[-1], 2))
        assert similarity(chain[0], chain[2]) < 0.8 <= similarity(chain[1], chain[2])
        texts |= {10 * n + k: t for k, t in enumerate(chain)}
        among += [(10 * n + a, 10 * n + b) for a in range(4) for b in range(a)]
    assert groups(spark, texts) == components(texts, among)


def test_large_group_of_edited_copies(spark):
    # More rows under a key than HOT_ROWS stands for: joined by pairs of components. Candidates are found with
    # a high probability, not always (0.988 at 0.80 to 0.83); the seed is one for which the keys meet.
    r = random.Random(15)
    base = r.choices(WORDS, k=100)
    texts = {i: edited(r, base, 1 + (i % 3 == 0)) for i in range(400)}
    far = edited(r, texts[7], 2)
    texts |= {1000: far, 1001: edited(r, far, 2)}
    assert groups(spark, texts) == components(texts, [(i, j) for i in texts for j in texts if i < j])


def test_similarity_is_exact_at_the_limit(spark):
    r, texts, among = random.Random(13), {}, []
    for n in range(60):
        base = r.choices(WORDS, k=400)
        texts |= {2 * n: base, 2 * n + 1: edited(r, base, 7 + n % 6)}
        among.append((2 * n, 2 * n + 1))
    assert {similarity(texts[i], texts[j]) >= 0.8 for i, j in among} == {True, False}
    assert groups(spark, texts) == components(texts, among)


def test_text_decides_not_the_commonest_shingle(spark):
    base = ["same"] * 60
    texts = {0: base, 1: [*base, *(f"a{i}" for i in range(20))], 2: [*base, *(f"b{i}" for i in range(20))]}
    assert groups(spark, texts) == {0: 0, 1: 1, 2: 2}


def test_language_stage_drops_junk_and_mixtures(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(14)
    by = {}
    for x in d.where("length(text) BETWEEN 700 AND 5000").orderBy("doc_id").limit(300).collect():
        by.setdefault(x.lang, []).append(x.text[:600])
    names = sorted(by)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(r.choice([100, 2000]))) for _ in range(40)]
    mixed = ["\n".join(r.choice(by[x]) for x in r.sample(names, r.choice([2, 3]))) for _ in range(40)]
    added = spark.createDataFrame([(10**7 + i, t, None) for i, t in enumerate(junk)] + [(2 * 10**7 + i, t, None) for i, t in enumerate(mixed)], d.schema)
    kept = [x.doc_id for x in corpus_pipeline.language_stage(spark, d.unionByName(added), sf).select("doc_id").collect()]
    assert sum(i < 10**7 for i in kept) >= 0.97 * d.count()
    assert sum(10**7 <= i < 2 * 10**7 for i in kept) == 0
    assert sum(i >= 2 * 10**7 for i in kept) <= 4
def test_null_and_repeated_ids(spark):
    import corpus_pipeline

    t = lambda seed: " ".join(random.Random(seed).choices(WORDS, k=30))
    rows = [(None, t(1)), (None, t(2)), (None, t(2)), (5, t(3)), (5, t(4)), (5, t(5)), (6, t(6)), (6, t(6)), (7, t(7)), (8, t(7))]
    got = []
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got.append(sorted(((x.doc_id or 0, x.text) for x in corpus_pipeline.near_duplicate_stage(spark, d, "").collect())))
    assert got[0] == got[1]
    assert [i for i, _ in got[0]] == [0, 0, 0, 5, 6, 7] and [x for i, x in got[0] if not i] == sorted([t(1), t(2), t(2)])

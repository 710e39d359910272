"""N-gram join against all pairs; components against union-find."""

import os
import random

import pytest

from quire.llm.components import components
from quire.llm.ngram_join import ngram_join


SF = "/root/testdata/sf0.01"


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[find(parent, a)] = find(parent, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        root = find(parent, k)
        least[root] = i if root not in least else min(least[root], i)
    return sorted((i, least[find(parent, k)], links[k]) for k, (i, _) in enumerate(rows))


def check(out, rows):
    """Classes are exact; links are found where there are some, and never more than there are."""
    got, want = sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=lambda r: str(r[0])), sorted(brute(rows), key=lambda r: str(r[0]))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all((g[2] > 0) == (w[2] > 0) and g[2] <= w[2] for g, w in zip(got, want))


def families(seed, n_base, n_near, length):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(n_base):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(length)]
        for _ in range(rng.randint(1, n_near)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(length)] = f"new{k}"
            rows.append((k, rng.choice([" ", "\n"]).join(own)))
            k += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_classes(spark, seed):
    rows = families(seed, 12, 12, 120) + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "two words"), (9004, "two\twords"), (9005, "long " * 30_000)]
    out = ngram_join(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")).collect()
    check(out, rows)


def test_one_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.ngram_join.BLOCK", 16)
    rows = families(5, 1, 1, 90)
    base = rows[0][1].split()
    rng = random.Random(8)
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            own[rng.randrange(len(own))] = f"other{k}"
        rows.append((k, " ".join(own)))
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(out, rows)


def test_isolated_pairs_beside_a_hot_group(spark):
    rng = random.Random(21)
    text = lambda: [f"{rng.choice('abcdefghij')}{rng.randint(0, 9999)}" for _ in range(120)]
    base, rows = text(), []
    for k in range(300):
        own = list(base)
        own[119] = f"hot{k}"
        rows.append((k, " ".join(own)))
    for k in range(300):
        one = text()
        other = list(one)
        for at in (30, 60, 118) if k % 2 else (30, 60):  # similarity 0.8125 and 0.841
            other[at] = f"new{k}"
        rows += [(1000 + 2 * k, " ".join(one)), (1001 + 2 * k, " ".join(other))]
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(out, rows)


def test_rows_that_share_an_id_or_have_none(spark):
    base = [f"w{k}" for k in range(60)]
    near, other = [*base[:59], "end"], [f"v{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, " ".join(near)), (None, " ".join([*other[:59], "end"])), (None, " ".join([*other[:58], "x", "y"]))]
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.class_id) for r in out) == [("1", 1), ("1", 1), ("2", 1), ("None", 1), ("None", 1)] and all(r.n_links for r in out)


def test_hashes_of_words_do_not_decide(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a + " p q r s t"), (2, a.translate(str.maketrans("ab", "ba")) + " p q r s t")]
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in out) == [(1, 1, 1, 0), (2, 2, 1, 0)]


def test_copies_of_a_text_that_differ_from_each_other(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.ngram_join.BLOCK", 16)
    rng = random.Random(31)
    base, rows = [f"w{rng.randint(0, 10**6)}" for _ in range(200)], []
    rows.append((500, " ".join(base)))
    for k in range(120):  # each has three changes of its own: 0.86 to the text, about 0.75 to each other
        own = list(base)
        for at in rng.sample(range(5, 195), 3):
            own[at] = f"new{k}"
        rows.append((k, " ".join(own)))
    check(ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_repeated_ids_and_nothing(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text than that is here"), (None, "a b c d e f g")]
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and sorted(r.n_links for r in out) == [0, 2, 2, 2]
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_recall_of_a_query_set_against_all_rows(spark):
    """Queries: ids divisible by 10 (the small table has few); a link is found if both texts are in one class."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = {r.doc_id: r.class_id for r in ngram_join(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    found = total = 0
    for q in (i for i in sets if i % 10 == 0):
        for j, other in sets.items():
            both = len(sets[q] & other)
            if j != q and both and 5 * both >= 4 * (len(sets[q]) + len(other) - both):
                total += 1
                found += own[q] == own[j]
    assert total > 10 and found >= 0.9 * total


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in got:
        assert got[x] == find(parent, x)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def template(k):
    """A page of one template: 0.62 of its runs are shared with every other one."""
    return " ".join([*(f"t{j}" for j in range(90)), *(f"own{k}x{j}" for j in range(23))])


def test_a_template_family_is_verified_in_linear_work(spark, monkeypatch):
    """Texts that only share a template have no links; what meets grows with them, not with their square."""
    from quire.llm import ngram_join as N

    monkeypatch.setattr(N, "BLOCK", 32)
    met = []
    real = N.met_all

    def counted(texts, members, *rest):
        met[-1] += members.count()
        return real(texts, members, *rest)

    monkeypatch.setattr(N, "met_all", counted)
    for n in (100, 200, 400):
        met.append(0)
        rows = [(k, template(k)) for k in range(n)] + [(1000 + k, template(k // 2 * 2) + f" end{k}") for k in range(0, 20)]
        out = {r.doc_id: r for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for k in range(n):
            near = k < 20 and k % 2 == 0
            assert (out[k].class_id, out[k].n_links > 0) == (k, near), k
        for k in range(20):
            assert out[1000 + k].class_id == k // 2 * 2 and out[1000 + k].n_links > 0
    assert max(met) <= 40  # the near pairs, whatever the family's size


def test_clusters_of_one_component_meet_hubs_of_their_own(spark, monkeypatch):
    from quire.llm import ngram_join as N

    monkeypatch.setattr(N, "BLOCK", 8)
    rng, rows = random.Random(17), []
    shared = [f"t{j}" for j in range(100)]
    for c in range(6):
        base = [*shared, *(f"c{c}w{j}" for j in range(45))]
        for k in range(20):
            own = list(base)
            for at in rng.sample(range(len(own)), rng.choice([0, 1, 2, 2])):
                own[at] = f"new{c}x{k}x{at}"
            rows.append((c * 100 + k, " ".join(own)))
    check(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_recall_of_many_near_links(spark):
    """Links between different texts of similarities from 0.8 on: 300 pairs, all of them beside a template family."""
    rng, rows = random.Random(77), []
    for k in range(300):
        words = [f"w{rng.randint(0, 10**7)}" for _ in range(150)]
        other = list(words)
        for at in rng.sample(range(5, 145), rng.choice([1, 2, 2, 3])):
            other[at] = f"new{k}x{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    rows += [(10_000 + k, template(k)) for k in range(200)]
    out = {r.doc_id: r.class_id for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = total = 0
    for a, b in zip(rows[:600:2], rows[1:600:2]):
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a[1].split(), b[1].split()))
        if len(x & y) >= 0.8 * len(x | y):
            total += 1
            found += out[a[0]] == out[b[0]]
    assert total >= 200 and found >= 0.99 * total


def test_all_links_of_texts_around_one_hub_are_counted(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows, n = [], 0
    for changes in (1, 2, 3, 6):
        base = [word() for _ in range(240)]
        for _ in range(30):
            text = list(base)
            for k in rng.sample(range(240), rng.randint(0, changes)):
                text[k] = word()
            rows.append((n, " ".join(text)))
            n += 1
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == brute(rows)

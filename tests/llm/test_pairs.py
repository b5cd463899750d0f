"""Near-duplicates and cross-split overlaps against brute force over all pairs."""

import itertools
import random
from pathlib import Path

import numpy as np
import pytest

from quorate.llm import near_duplicates as nd
from quorate.llm import overlap as ov
from quorate.llm.text import content_of, words_of
from quorate.plans import runtime


def jaccard(a, b):
    a, b = set(words_of(content_of(a))), set(words_of(content_of(b)))
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def rows(state):
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(3000)]
    common = ["the", "of", "and", "in", "was", "by", "from", "with"]
    out = []
    for k in range(60):
        words = [rng.choice(common) if rng.random() < 0.4 else rng.choice(names) for _ in range(rng.choice([18, 40, 90]))]
        out.append(words)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 15))):
                i = rng.randrange(len(copy))
                rng.choice([lambda: copy.pop(i), lambda: copy.insert(i, rng.choice(names)), lambda: copy.__setitem__(i, rng.choice(names))])()
            out.append(copy)
    found = [{"row_id": f"r{k:04d}", "state": state(" ".join(w[:8]), " ".join(w[8:])), "split": ["train", " Test", "dev", None][k % 4], "source": "a"} for k, w in enumerate(out)]
    odd = [{"row_id": "e1", "state": None, "split": "val"}, {"row_id": "e2", "state": "", "split": "val"}, {"row_id": "e3", "state": "{}", "split": "train"}, {"row_id": None, "state": "x y z", "split": "train"}]
    long = {"row_id": "long", "state": " ".join(f"w{k}" for k in range(30000)), "split": "test"}
    return found + odd + [long, dict(long, row_id="long2", split="TRAIN"), found[0]]


def truth(rows):
    one = {r["row_id"]: r for r in rows if r["row_id"] and r["state"]}
    return {tuple(sorted((a, b))) for a, b in itertools.combinations(one, 2) if jaccard(one[a]["state"], one[b]["state"]) >= 0.6}, one


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates_equal_brute_force(fixture_rows, rows, block):
    found = nd.near_duplicates(fixture_rows(rows), nd.Params(block=block, small=0 if block == 2 else 500_000))
    want, _ = truth(rows)
    assert {tuple(r) for r in nd.record_pairs(found).collect()} == want
    groups = {r.row_id: r.group_row_id for r in nd.record_groups(found).collect()}
    assert set(groups) == {r["row_id"] for r in rows if r["row_id"]}
    for a, b in want:
        assert groups[a] == groups[b] <= min(a, b)
    assert groups["e1"] == "e1" and groups["e2"] == "e2"


@pytest.mark.parametrize("block", [8192, 16])
def test_a_hot_family_of_edited_variants_keeps_all_its_pairs(fixture_rows, block):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    base = [word() for _ in range(41)]
    texts = []
    for _ in range(60):  # a third of all rows; one to five words replaced by words of their own
        copy = list(base)
        for i in rng.sample(range(41), rng.randint(1, 5)):
            copy[i] = word()
        texts.append(copy)
    texts += [[word() for _ in range(41)] for _ in range(120)]
    rows = [{"row_id": f"h{k:03d}", "state": " ".join(x)} for k, x in enumerate(texts)]
    want, _ = truth(rows)
    found = nd.near_duplicates(fixture_rows(rows), nd.Params(block=block))
    assert len(want) > 1500 and {tuple(r) for r in nd.record_pairs(found).collect()} == want


def test_near_duplicates_of_nothing(fixture_rows):
    found = nd.near_duplicates(fixture_rows([]))
    assert nd.record_pairs(found).count() == 0 and nd.record_groups(found).count() == 0


def test_many_copies_make_one_node(fixture_rows, state):
    rows = [{"row_id": f"c{k:03d}", "state": state("one two three four five six seven", "eight nine ten")} for k in range(40)]
    found = nd.near_duplicates(fixture_rows(rows))
    assert found.links.count() == 0
    assert nd.record_pairs(found).count() == 40 * 39 // 2


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    a = np.arange(60, dtype=np.uint32)
    b = np.arange(20, 80, dtype=np.uint32)
    w = rng.uniform(0.1, 1, 80)
    values = np.concatenate([a, b])
    sig = nd.probminhash(values, np.array([0, 60, 120]), w[values], 4096)
    expected = w[20:60].sum() / w.sum()  # equal weights in both: the weighted Jaccard of the sets
    assert abs((sig[0] == sig[1]).mean() - expected) < 0.03


def test_overlaps_equal_brute_force(fixture_rows, rows):
    want, one = truth(rows)
    split = {k: {"train": "train", "TRAIN": "train", " Test": "test", "test": "test", "dev": "val", "val": "val"}.get(r["split"]) for k, r in one.items()}
    want = {p for p in want if {split[p[0]], split[p[1]]} in ({"train", "test"}, {"train", "val"})}
    for shard in (3_000_000, 400):
        params = ov.Params(shard_words=shard)
        assert {tuple(r) for r in ov.overlap_pairs(fixture_rows(rows), params).collect()} == want
    report = ov.overlap_report(fixture_rows(rows), ov.Params()).collect()
    assert sum(r.pairs for r in report) == len(want)


@pytest.mark.parametrize("gap", [4, 5, 6, 8])
def test_overlaps_of_texts_with_an_edit_every_few_words(fixture_rows, gap):
    rng = random.Random(gap)
    rows = []
    for k, n in enumerate([60, 61, 100, 200, 35, 19]):
        words = [f"g{k}x{i}" for i in range(n)]
        edited = [w if i % gap != gap - 1 else "new" + w for i, w in enumerate(words)]
        mixed = rng.sample(words, n)  # the same words in another order
        rows += [{"row_id": f"{x}{k}", "state": " ".join(w), "split": s} for x, w, s in (("a", words, "test"), ("b", edited, "train"), ("c", mixed, "train"))]
    want = {p for p in truth(rows)[0] if p[0][0] == "a"}
    assert len(want) == (12 if gap > 4 else 6 + sum(jaccard(rows[3 * k]["state"], rows[3 * k + 1]["state"]) >= 0.6 for k in range(6)))
    assert {tuple(r) for r in ov.overlap_pairs(fixture_rows(rows), ov.Params()).collect()} == want


def test_overlaps_of_a_family_of_many_evaluation_texts(fixture_rows):
    rng = random.Random(2)
    base = [f"f{i}" for i in range(60)]
    variants = [[w if (i + k) % 12 else f"v{k}x{i}" for i, w in enumerate(base)] for k in range(12)]  # no twelve words in a row are left
    texts = [[w if i != j else f"e{k}" for i, w in enumerate(variants[k % 12])] for k in range(90) for j in [rng.randrange(60)]]
    rows = [{"row_id": f"{'t' if k < 6 else 'e'}{k:02d}", "state": " ".join(x), "split": "train" if k < 6 else "test"} for k, x in enumerate(texts)]
    want = {p for p in truth(rows)[0] if p[0][0] != p[1][0]}
    assert len(want) > 400 and {tuple(r) for r in ov.overlap_pairs(fixture_rows(rows), ov.Params()).collect()} == want


def test_overlaps_of_nothing(fixture_rows, rows):
    assert ov.cross_split_overlaps(fixture_rows([])).count() == 0
    assert ov.cross_split_overlaps(fixture_rows([r for r in rows if r["split"] == "train"])).count() == 0


@pytest.mark.parametrize("params", [{"posts": 1}, {"posts": 1, "block": 8, "hits": 50}, {"posts": 2, "depths": ((12, 3), (20, 2)), "small": 0, "width": 64}])
def test_overlaps_of_texts_of_few_frequent_words(fixture_rows, params):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(24)]
    rows = [{"row_id": f"{'et'[k % 2]}{k:03d}", "state": " ".join(rng.sample(words, rng.choice([1, 2, 3, 5, 8, 11, 14, 20]))), "split": ["test", "train"][k % 2]} for k in range(240)]
    want = {p for p in truth(rows)[0] if p[0][0] != p[1][0]}
    assert len(want) > 250 and {tuple(r) for r in ov.overlap_pairs(fixture_rows(rows), ov.Params(**params)).collect()} == want


def test_records_go_to_the_shards_of_their_candidates_only(spark, fixture_rows):
    rows = [{"row_id": f"e{k:03d}", "state": " ".join(f"e{k}x{i}" for i in range(20)), "split": "test"} for k in range(300)]
    rows += [{"row_id": f"t{k:03d}", "state": " ".join(f"e{k}x{i}" for i in range(1, 20)) if k < 2 else f"other{k} text{k}", "split": "train"} for k in range(100)]
    base = runtime.shared_dir(spark).removeprefix("file://")
    before = set(Path(base).glob("index-*"))
    found = ov.overlap_pairs(fixture_rows(rows), ov.Params(shard_words=20)).collect()
    assert {tuple(r) for r in found} == {("e000", "t000"), ("e001", "t001")}
    shards = [x for path in set(Path(base).glob("index-*")) - before for x in path.glob("shard=*")]
    assert 1 <= len(shards) <= 2  # not the index of 300 texts, of which every training record once searched every shard


def maximal_matches(x, y, least):
    """(number, words of x covered, longest) of the maximal matches, by all pairs of places."""
    ends = {}
    for i in range(len(x)):
        for j in range(len(y)):
            n = 0
            while i - n >= 0 and j - n >= 0 and x[i - n] == y[j - n]:
                n += 1
            ends[i] = max(ends.get(i, 0), n)
    spans = [(i, n) for i, n in ends.items() if n >= least and ends.get(i + 1, 0) <= n]
    return len(spans), len({k for i, n in spans for k in range(i - n + 1, i + 1)}), max((n for _, n in spans), default=0)


@pytest.mark.parametrize("shard", [3_000_000, 300])
def test_maximal_matches_equal_brute_force(fixture_rows, rows, shard):
    one = truth(rows)[1]
    found = ov.cross_split_overlaps(fixture_rows(rows), ov.Params(min_match=4, shard_words=shard)).where("row_id_eval <> 'long'").collect()
    assert len(found) > 10
    for r in found:
        x, y = words_of(content_of(one[r.row_id_train]["state"])), words_of(content_of(one[r.row_id_eval]["state"]))
        assert (r.matches, r.words_covered, r.longest) == maximal_matches(x, y, 4)
        assert abs(r.similarity - jaccard(one[r.row_id_train]["state"], one[r.row_id_eval]["state"])) < 1e-9


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint32) for _ in range(30)]
    index = ov.Index(ov.build_index([str(k) for k in range(30)], docs, ov.Params()))
    unique = {x.tobytes(): x for x in docs}.values()
    for pattern in itertools.product(range(5), repeat=3):
        lo, hi = index.first[pattern[2]], index.first[pattern[2] + 1]
        lo, hi = np.array([lo]), np.array([hi])
        for s in (pattern[1], pattern[0]):
            lo, hi = index.step(np.array([s]), lo, hi)
        n = sum(tuple(x[i : i + 3]) == pattern for x in unique for i in range(len(x) - 2))
        assert max(0, hi[0] - lo[0]) == n

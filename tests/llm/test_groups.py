"""One document of each group of near-duplicates, with null and repeated ids."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from presetlake.llm import graph, simhash
from tests.llm.test_operators import plain_components


def texts(word):
    """Two texts that differ in case, which fingerprints ignore."""
    return [" ".join(f"{word}{i}" for i in range(60)), " ".join(f"{word}{i}" for i in range(60)).upper()]


def kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def test_null_ids_stay_once_for_a_group_without_ids_only(spark):
    (a, a2), (b, b2) = texts("a"), texts("b")
    got = kept(spark, [(None, a), (None, a2), (1, b), (None, b2), (None, b)])
    assert len(got) == 2 and (1, b) in got and {t for i, t in got if i is None} < {a, a2}


def test_a_repeated_id_keeps_one_text_of_a_group(spark):
    (a, a2), (b, b2) = texts("a"), texts("b")
    got = kept(spark, [(1, a), (1, a2), (1, a), (2, a), (1, b), (3, b2)])
    assert len(got) == 2 and (1, b) in got and {t for _, t in got} - {b} < {a, a2}


def test_the_smallest_id_of_a_group_stays(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    assert kept(spark, [(2, b), (5, a), (5, b), (7, c)]) == [(2, b), (5, a), (7, c)]
    assert kept(spark, [(2, a), (2, a.upper()), (3, a)])[0][0] == 2 and len(kept(spark, [(2, a), (2, a.upper()), (3, a)])) == 1
    assert len(kept(spark, [(4, ""), (4, None), (None, "  "), (9, "\n")])) == 1


def jaccard(a, b, words=5):
    a, b = ({tuple(t[i : i + words]) for i in range(len(t) - words + 1)} for t in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("crowd", [1 << 20, 64, 8])
def test_one_of_each_pair_of_near_copies_stays_and_clean_texts_stay(spark, monkeypatch, crowd):
    """Near copies by a word changed here and there, and by a passage put in; all masks, or few to a group."""
    monkeypatch.setattr(simhash.wide_link, "__defaults__", (simhash.WIDE, crowd, 40 if crowd == 8 else simhash.GROUP))
    draw, texts, pairs = random.Random(4), {}, []
    word = lambda: f"w{draw.randrange(3_000)}"
    for i in range(400):
        own = [word() for _ in range(draw.randrange(60, 400))]
        texts[2 * i] = " ".join(own)
        if i % 2:
            continue
        copy = list(own)
        if i % 4:
            for at in range(draw.randrange(60), len(own), 60):
                copy[at] = word()
        else:
            at = draw.randrange(len(own))
            copy[at:at] = [word() for _ in range(len(own) // 8)]
        texts[2 * i + 1] = " ".join(copy)
        if jaccard(texts[2 * i], texts[2 * i + 1]) >= 0.8:
            pairs.append((2 * i, 2 * i + 1))
    stays = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {2 * i for i in range(400)} <= stays  # each smallest id, and each text without a copy
    assert len(pairs) > 150 and np.mean([b not in stays for _, b in pairs]) > (0.8 if crowd == 8 else 0.93)


def test_wide_links_are_those_of_all_pairs(spark):
    draw = np.random.default_rng(2)
    base = draw.integers(-(1 << 63), 1 << 63, (90, 2), dtype=np.int64)
    flips = [sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 16), False)) for _ in range(180)]
    near = base ^ np.array(flips, np.uint64).view(np.int64).reshape(90, 2)
    fps = np.unique(np.concatenate([base, near]), axis=0).tolist()
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(fps)], "node long, high long, low long")
    got = {r.node: r.root for r in graph.components(simhash.wide_link(rows)).collect()}
    far = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    want = plain_components([(a, b) for a, b in combinations(range(len(fps)), 2) if far(fps[a], fps[b]) <= simhash.WIDE], range(len(fps)))
    assert {i: got.get(i, i) for i in range(len(fps))} == want
    sizes = defaultdict(int)
    for root in want.values():
        sizes[root] += 1
    assert max(sizes.values()) == 2 and len(sizes) > 90

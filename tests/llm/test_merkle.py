import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusquery.llm import merkle, sha256
from corpusquery.llm.queries import op12_merkle_manifest

DDL = "doc_id long, source string, lang string, n_chars long, text string, pos string, GRP int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def climb(levels, at, digest):
    proof = []
    for level in levels[:-1]:
        first = at // 3 * 3
        run = level[first : first + 3]
        proof += [d for k, d in enumerate(run) if first + k != at]
        run[at - first] = digest
        digest, at = h(*run), at // 3
    return digest, proof


def expected(rows):
    def leaf(r, text):
        return h(*map(field, (r[0], r[1], r[2], r[3], text)))

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: levels_of([leaf(r, r[4]) for r in groups[s]]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    root = top[-1][0] if order else None
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            middle, low = climb(trees[s], i, leaf(r, text))
            folded, high = climb(top, k, middle)
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], root, h(*low, *high), folded, folded == root))
    return sorted(out, key=str)


def found(spark, rows, tmp_path):
    wide = [(*r, "x", 1) for r in rows]
    spark.createDataFrame(wide, DDL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_hashes_in_lanes_equal_the_library():
    rng = np.random.default_rng(1)
    for n_blocks in range(4):
        words = rng.integers(0, 1 << 32, (n_blocks, 5000, 16), np.uint64).astype(np.uint32)
        state = sha256.start(5000)
        for block in words:
            state = sha256.absorb(state, block)
        digests = sha256.finish(state, n_blocks)
        for i in (0, 1, 4095, 4096, 4999):
            message = words[:, i].astype(">u4").tobytes()
            assert sha256.to_bytes(digests[i : i + 1]) == hashlib.sha256(message).digest()


def test_hex_blocks_are_the_text_of_a_digest():
    digest = hashlib.sha256(b"x")
    block = sha256.hex_blocks(sha256.from_bytes(digest.digest()))
    assert block.astype(">u4").tobytes() == digest.hexdigest().encode()


@settings(deadline=None, max_examples=30)
@given(st.integers(1, merkle.BLOCK), st.integers(0, 5), st.randoms())
def test_any_changed_node_of_a_block_climbs_like_a_new_tree(n, spare, chance):
    levels = max(spare, merkle._levels(n))
    leaves = [h(str(i)) for i in range(n)]
    nodes, states, top = merkle.build_blocks([sha256.from_bytes(bytes.fromhex("".join(leaves)))], [levels])[0]
    at, other = chance.randrange(n), h("other")
    steps = merkle.block_steps(n, levels, nodes, states, np.array([at]))
    got, _ = merkle.climb(sha256.from_bytes(bytes.fromhex(other)), steps)
    for replaced, digest in ((False, top), (True, sha256.to_bytes(got))):
        level = [other if replaced and i == at else d for i, d in enumerate(leaves)]
        for _ in range(levels):
            level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        assert level == [digest.hex()]


def test_folding_takes_no_left_sibling():
    leaves = [h(str(i)) for i in range(9)]
    nodes, states, _ = merkle.build_blocks([sha256.from_bytes(bytes.fromhex("".join(leaves)))], [2])[0]
    steps = merkle.block_steps(9, 2, nodes, states, np.array([5]))
    digest = sha256.from_bytes(bytes.fromhex(leaves[5]))
    whole, _ = merkle.climb(digest, steps)
    steps["siblings"][0, 0, :2] = 0  # both others stand to the left of place 2
    steps["siblings"][0, 1, 0] = 0  # one stands to the left of place 1
    assert (merkle.climb(digest, steps)[0] == whole).all()


def test_manifest_equals_plain_hashing(spark, tmp_path):
    chance = random.Random(5)
    rows = []
    # One source of several blocks, sources of one leaf, of one block and of one more leaf.
    for source, n in (("hot", 2 * merkle.BLOCK + 5), ("one", 1), ("é", 3), (None, 7), ("full", merkle.BLOCK), ("over", merkle.BLOCK + 1)):
        for i in range(n):
            text = chance.choice([None, "", "a\nb", "plain", "\n", "naïve\n日本", "long " * 3000])
            rows.append((len(rows), source, chance.choice(["en", None]), chance.choice([None, 5]), text))
    rows += rows[:3]  # repeated rows
    rows += [(None, "one", None, None, None), (None, None, None, None, "x\ny"), (7, "hot", "en", 1, "same id")]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_many_sources(spark, tmp_path):
    rows = [(i, f"s{i % 700}", "en", i, "a\nb") for i in range(1000)]
    assert found(spark, rows, tmp_path) == expected(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, tmp_path, n):
    rows = [(3, None, None, None, "a\nb")] * n
    assert found(spark, rows, tmp_path) == expected(rows)

"""The packer with its bitset against bounded-space best-fit written as a list of open bins."""

import random

import pytest

from lodestar.llm.best_fit_packing import BestFit


def plain_best_fit(sizes, capacity, most):
    """``(bin, offset)`` of each piece: the fullest open bin that holds it, the latest of equals; else a new bin.

    A bin that is full closes; with ``most`` bins open, the fullest closes before another opens.
    """
    opened, made, out = [], 0, []  # (fill, when it was last touched, bin)
    for turn, size in enumerate(sizes):
        fits = [b for b in opened if b[0] + size <= capacity]
        if fits:
            best = max(fits)
            opened.remove(best)
        else:
            if len(opened) >= most:
                opened.remove(max(opened))
            best = (0, turn, made)
            made += 1
        out.append((best[2], best[0]))
        if best[0] + size < capacity:
            opened.append((best[0] + size, turn, best[2]))
    return out


@pytest.mark.parametrize("capacity, most", [(2048, 128), (2048, 1), (64, 4), (10, 3), (1, 2)])
def test_placed_as_by_plain_best_fit(capacity, most):
    rng = random.Random(capacity + most)
    for draw in (lambda: rng.randint(1, capacity), lambda: min(capacity, 1 + int(rng.expovariate(8 / capacity))), lambda: rng.choice([1, capacity, (capacity + 1) // 2])):
        sizes = [draw() for _ in range(3_000)]
        packer = BestFit(capacity, most)
        got = [packer.place(size) for size in sizes]
        assert [(b, o) for b, o, _ in got] == plain_best_fit(sizes, capacity, most)
        closed = [b for _, _, done in got for b in done]
        assert len(closed) == len(set(closed)) and packer.n_open <= most
        assert sorted([*closed, *packer.filled]) == list(range(packer.n_made))


def test_tasks_are_packed_like_the_plain_version(spark):
    """One task's closed bins are the plain version's; its last open bins are packed once more by the same rule."""
    import public_tokenizers

    from lodestar.llm.best_fit_packing import pack_documents

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "of", "x1"]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=128, open_bins=4).collect()
    pieces = sorted(rows, key=lambda r: (r["doc_id"], r["piece"]))
    placed = plain_best_fit([r["length"] for r in pieces], 128, 4)
    got, want = {}, {}
    for r, (b, offset) in zip(pieces, placed, strict=True):
        got.setdefault(r["sequence_id"], []).append((r["offset"], r["doc_id"], r["piece"]))
        want.setdefault(b, []).append((offset, r["doc_id"], r["piece"]))
    got, want = ({tuple(sorted(x)) for x in groups.values()} for groups in (got, want))
    # At most the last four bins of the task may have been joined.
    assert len(want - got) <= 4 and len(got - want) <= 4 and len(got) <= len(want)

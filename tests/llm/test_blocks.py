"""Near-duplicate embeddings in many blocks, slices and turns against brute force; what is written of the vectors."""

import numpy as np
import pytest

from tessella.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(made):
    x = np.array([e for _, e, _ in made])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for _, _, k in made])
    close = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    name = np.arange(len(made))
    while True:
        least = np.minimum(name, np.where(close, name[None, :], len(made)).min(axis=1))
        if (least == name).all():
            return [(i, int(close[i].sum()), int(name[i]), bool(name[i] == i)) for i in range(len(made))]
        name = least


def vectors(n, groups, spread, labels, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, 8))
    return [(i, [float(np.float32(v)) for v in base[rng.integers(groups)] + rng.standard_normal(8) * spread], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("groups", "spread", "labels"), [(400, 1.0, 1), (6, 0.25, 2), (1, 0.05, 1)])
def test_turns_and_slices_lose_and_repeat_no_pair(spark, monkeypatch, groups, spread, labels):
    for name, value in (("CELL_ROWS", 60), ("BLOCK_ROWS", 25), ("VISITORS", 1), ("AT_ONCE", 1), ("STEP_ROWS", 16), ("STEP", 64)):
        monkeypatch.setattr(embed_dedup, name, value, raising=False)
    dealt, turns = embed_dedup._dealt, set()
    monkeypatch.setattr(embed_dedup, "_dealt", lambda *a: (turns.add(a[4]) if len(a) > 4 else None, dealt(*a))[1])
    made = vectors(300, groups, spread, labels, 3) + [(300, [1.0] + [0.0] * 7, 9), (301, [1.0] + [0.1] * 7, 9)]
    got = embed_dedup.near_embeddings(spark.createDataFrame(made, SCHEMA)).collect()
    assert sorted((r.row_id, r.n_links, r.component_id, r.kept) for r in got) == brute(made)
    assert len(turns) > 1


def test_each_pair_of_blocks_meets_once():
    for blocks in range(1, 9):
        layout = embed_dedup.Layout(np.array([7, 0, blocks * 10 - 7]), 10)
        assert layout.blocks == blocks
        assert (layout.visits + layout.visits.T + np.eye(blocks) == 1).all()
        number, home = np.arange(blocks * 10) * 3, np.repeat([0, 2], [7, blocks * 10 - 7])
        assert layout.has[home, layout.block(number, home)].all()


def test_vectors_are_written_once_and_not_for_each_cell_or_block(spark, monkeypatch):
    written, write = [], embed_dedup.materialize

    def noted(df, name, *a):
        out = write(df, name, *a)
        if "array<float>" in df.schema.simpleString() or "array<double>" in df.schema.simpleString():
            written.append((name, out.count(), out))
        return out

    monkeypatch.setattr(embed_dedup, "materialize", noted)
    made = vectors(1200, 1200, 1.0, 1, 4)
    got = embed_dedup.near_embeddings(spark.createDataFrame(made, SCHEMA)).collect()
    assert len(got) == 1200
    assert written and all(n <= 1200 for _, n, _ in written)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    for _, _, table in written:
        path = files.Path(table.inputFiles()[0])
        assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)  # none is left when links are known

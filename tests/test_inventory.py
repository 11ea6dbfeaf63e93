"""File inventory (S15, A16, A17) on a small directory tree."""

import os

from tessera.operators import inventory as I


def write(path, n):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"x" * n)


def test_listing_summary_and_weights(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    write(f"{root}/a.bin", 10)
    write(f"{root}/run1/model.safetensors", 100)
    write(f"{root}/run1/ckpt/step-1/model.safetensors", 50)
    write(f"{root}/run2/log.txt", 7)
    files = I.list_files(spark, root)
    assert files.count() == 4 and "content" not in files.columns
    summ = {r.dir: (r.n_files, r.bytes, r.n_subdirs) for r in I.directory_summary(files, root).collect()}
    assert summ[""] == (4, 167, 2)
    assert summ["run1"] == (2, 150, 1)
    assert summ["run1/ckpt/step-1"] == (1, 50, 0)
    w = I.weight_inventory(files, r"\.safetensors$").first()
    assert (w.n_files, w.total_bytes) == (2, 150)
    top = [r.length for r in I.largest_children(files, 2).collect()]
    assert top == [100, 50]

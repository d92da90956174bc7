"""Belief propagation over directory trees against the sum over all joint states."""

import itertools
import math
import random

from lodestrata.llm import provenance as p

SCHEMA = "point_id string, project_id string, file_path string, " + ", ".join(f"e{k} double" for k in p.STATES)


def joint(files, file_pull, folder_pull):
    """Marginals of the files of one project by summing over the states of all nodes."""
    folders = {""}
    for path, _ in files:
        steps = path.split("/")[:-1]
        folders |= {"/".join(steps[:i]) for i in range(len(steps) + 1)}
    folders = sorted(folders)
    f, g = p.compatibility(file_pull), p.compatibility(folder_pull)
    out = [[0.0] * len(p.LABELS) for _ in files]
    for states in itertools.product(p.STATES, repeat=len(folders)):
        of = dict(zip(folders, states))
        weight = math.prod(g[of[d]][of[d.rpartition("/")[0]]] for d in folders if d)
        up = [[math.exp(e[k]) * f[k][of[path.rpartition("/")[0]]] for k in p.STATES] for path, e in files]
        sums = [sum(x) for x in up]
        for i, x in enumerate(up):
            rest = weight * math.prod(sums[:i] + sums[i + 1 :])
            for k in p.STATES:
                out[i][k] += rest * x[k]
    return [[x / sum(m) for x in m] for m in out]


def test_beliefs_are_the_exact_marginals(spark):
    rng = random.Random(5)
    trees = {"a": ["x.py", "s/y.py", "s/t/u/z.py", "s/t/w.py"], "b": ["v/1", "v/2", "v/3", "w/q/4", "w/q/5"], "\0": ["r"]}
    files = {q: [(path, [0.0] + [rng.uniform(-4, 3) for _ in range(4)]) for path in paths] for q, paths in trees.items()}
    rows = [(f"{q}{path}", q, path, *e) for q, own in files.items() for path, e in own]
    got = {r.point_id: r for r in p.propagate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for q, own in files.items():
        for (path, _), m in zip(own, joint(own, p.FILE_PULL, p.FOLDER_PULL)):
            r = got[f"{q}{path}"]
            assert r.label == p.LABELS[max(p.STATES, key=lambda k: m[k])] and abs(r.belief - max(m)) < 1e-9


def test_siblings_decide_a_file_of_weak_evidence(spark):
    weak, vendored, own = [0.0, -5.0, -5.0, -1.0, -5.0], [0.0, -5.0, -5.0, 15.0, -5.0], [0.0] + [-5.0] * 4
    rows = [("w", "p", "lib/x/w.js", *weak), *((f"v{i}", "p", f"lib/x/{i}.js", *vendored) for i in range(4)), *((f"h{i}", "p", f"src/{i}.js", *own) for i in range(4)), ("c", "p", "src/c.js", *weak)]
    label = {r.point_id: r.label for r in p.propagate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert label["w"] == "vendored" and label["c"] == "handwritten"
    assert p.propagate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_files_and_late_banners_are_read(spark):
    library = p.Library([])
    late = "x = 1\n" * 400 + "/*!\n * thing v1.2.3\n * (c) thing contributors\n */\n"
    assert max(p.evidence("a/t.js", late, library)) > 0
    header = "// licence\n" * 40 + "// Code generated by gen. DO NOT EDIT.\nx()\n"
    assert p.evidence("a.go", header, library)[1] > 0


def test_one_clue_is_decided_by_the_folder(spark):
    clue = [float(x) for x in p.evidence("vendor/kit/w.js", "export const a = 1;\n", p.Library([]))]
    copy, own = [0.0, -4.0, -4.0, 16.0, -4.0], [0.0] + [-4.0] * 4
    rows = [("a", "p", "vendor/kit/w.js", *clue), *((f"a{i}", "p", f"vendor/kit/{i}.js", *copy) for i in range(5)), ("b", "q", "vendor/kit/w.js", *clue), *((f"b{i}", "q", f"vendor/kit/{i}.js", *own) for i in range(5))]
    label = {r.point_id: r.label for r in p.propagate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert max(range(5), key=lambda k: clue[k]) == 0 and label["a"] == "vendored" and label["b"] == "handwritten"

import hashlib
import zlib

from loadcurve.llm import manifest as mf
from tests.llm.frames import DOC, clashing, documents, odd_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def _sides(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        at //= 8
    return out


def _plain(rows):
    """Each row's columns by the definition, one whole tree in memory."""
    trees = {}
    for i, t, lang, source, n in rows:
        low = None if t is None else t.translate(LOWER)
        touched = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        first = _leaf((i, source, lang, n, t))
        trees.setdefault(lang, []).append(((i is not None, i), first, _leaf((i, source, lang, n, low)) if touched else first))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda x: (x[0][0], x[0][1] or 0, x[1]))
    inner = {lang: _levels([x[1] for x in trees[lang]]) for lang in langs}
    top = _levels([inner[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, (key, first, changed) in enumerate(trees[lang]):
            sides = _sides(inner[lang], at) + _sides(top, place)
            folded = changed
            for a, b in sides:
                folded = _h(a + folded + b)
            out.append((key[1], first, inner[lang][-1][0], top[-1][0], _h("".join(a + b for a, b in sides)), folded, folded == top[-1][0]))
    return out


def _check(spark, rows, frame=None):
    frame = spark.createDataFrame(rows, DOC) if frame is None else frame
    got = mf.audit_versions(frame, mf.lower_case_of_thirds()).collect()
    order = lambda x: tuple(map(str, x))
    assert sorted((tuple(r)[:7] for r in got), key=order) == sorted(_plain(rows), key=order)
    return got


def test_equal_to_one_whole_tree(spark, rng):
    rows = [(i, f"Text {i}é", "en", f"s{i % 3}", i) for i in rng.sample(range(10**6), 1700)]  # over three blocks
    rows += [(i, f"Other {i}", "de", None, None) for i in range(513)] + [(i, "SAME", "fr", "s", 1) for i in range(512)]
    rows += [(7, "one", None, "s", 1), (-5, "UPPER", "zz", "s", 1), (None, "No Id", "zz", "s", 1), (None, None, "zz", None, None)]
    rows += [(12, "Again", "é", "s", 1)] * 20 + [(i, t, "odd", "s", 1) for i, t in enumerate(odd_texts(rng))]
    got = _check(spark, rows, clashing(spark.createDataFrame(rows, DOC)).repartition(5))
    assert not all(r.verified for r in got) and {r.copied for r in got if r.verified} >= {0}


def test_many_groups(spark):
    _check(spark, [(i, f"T{i}", f"l{i % 700}", "s", i) for i in range(1500)])


def test_several_levels_of_blocks(spark, monkeypatch, rng):
    """Blocks of 8 leaves: four levels of blocks within a group, two over the groups."""
    monkeypatch.setattr(mf, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(mf, "BLOCK", 8)
    _check(spark, [(i, f"T{i}", "en" if i % 3 else f"l{i % 30}", "s", i) for i in range(900)])


def test_lone_leaf_and_empty_table(spark):
    (only,) = _check(spark, [(2, "A", "en", "s", 1)])
    assert only.leaf == only.subroot == only.root and only.proof_sha256 == _h("")
    assert mf.audit_versions(documents(spark, []), mf.lower_case_of_thirds()).count() == 0


def test_versions_share_untouched_nodes():
    tree = mf.Versions([_h(str(i)) for i in range(500)])
    nodes, top = len(tree.digests), tree.top
    first = tree.write(77, _h("x"))
    assert len(tree.digests) == nodes + 1 + tree.height and tree.top == top
    shared = set(tree.children[first]) & set(tree.children[top])
    assert len(shared) == len(tree.children[top]) - 1
    again = tree.write(77, _h("77"))
    assert tree.digests[again] == tree.digests[top] and again != top

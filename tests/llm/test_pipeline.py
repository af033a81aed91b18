import collections

import corpus_pipeline
from tidelog.llm import common, line_quality, packing

from .helpers import awkward, components, docs, fingerprint, prose, words
from .test_mixing import plain_targets


def test_stages_against_plain_versions(spark):
    base = [(500 + k, "\n".join(prose(12, 900 + k))) for k in range(24)]
    rows = awkward(base + [(600, base[0][1] + " "), (601, base[1][1].replace("a", "A", 1)), (602, "junk ### *** | | |\n" * 9), (503, base[3][1]), (504, base[4][1] + " End."), (None, base[5][1]), (None, base[6][1] + "\n")])
    rows += [(700, "\n".join(prose(9, 1500)), None, None, None, "q", "x", 1)] * 3 + [(None, "\n".join(prose(9, 1501)), "en", "s0", 1, "q", "x", 1)] * 3
    at, seen = docs(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        at = common.staged(stage(spark, at, ""), "t")
        seen[name] = at.collect()
        if name != "packing":
            assert at.columns == docs(spark, rows).columns
    # nulls, ties and repeated rows go through every stage
    listed = lambda found: sorted(((r.doc_id, r.text) for r in found), key=str)
    facts = line_quality.clean(docs(spark, rows)).collect()
    assert listed(seen["quality rules"]) == sorted(((r.doc_id, r[-1].clean_text) for r in facts if r[-1].kept), key=str)
    assert {r.doc_id for r in seen["quality rules"]} >= {i for i, _ in base} and 602 not in {r.doc_id for r in seen["quality rules"]}
    groups = collections.defaultdict(list)
    for r in seen["quality rules"]:
        groups["".join(words(r.text))].append((-len(r.text), r.doc_id is None, r.doc_id or 0))
    exact = sorted((("".join(words(r.text)), -len(r.text), r.doc_id is None, r.doc_id or 0) for r in seen["exact dedup"]))
    assert exact == sorted((g, *min(v)) for g, v in groups.items())
    texts = [r.text for r in seen["exact dedup"]]
    prints = [fingerprint(t) for t in texts]
    root = components(len(texts), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    least = {}
    for k, r in enumerate(seen["exact dedup"]):
        own = (r.doc_id is None, r.doc_id or 0)
        least[root[k]] = min(least.get(root[k], own), own)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in seen["near dedup"]) == sorted(least.values())
    sizes, taken = collections.Counter(), collections.Counter()
    for r in seen["near dedup"]:
        sizes[r.source] += len(words(r.text))
    for r in seen["mixing"]:
        taken[r.source] += len(words(r.text))
    want = plain_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.5000001 for s in sizes)
    whole = {r.text for r in seen["near dedup"]}
    assert sum(r.text not in whole for r in seen["mixing"]) <= len(sizes)  # a document at each source's cut
    encode = packing.Ids(packing.vocabulary_path())
    assert sum(r.length for r in seen["packing"]) == sum(len(encode(r.text)) // 4 + 1 for r in seen["mixing"])


def test_run_over_a_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns

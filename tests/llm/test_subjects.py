import random

from foliomill.llm import subjects

WORDS = {1: ["atom", "enzyme", "orbit", "fossil"], 2: ["court", "clause", "judge", "verdict"], 3: ["goal", "referee", "racket", "medal"]}
PLAIN = ["the letter was found again", "a visitor asked for the folder", "nobody saw the cabinet"]


def document(rnd, about, n):
    out = []
    for i in range(n):
        s = about[i % len(about)] if about else None
        out.append(f"The {rnd.choice(WORDS[s])} and the {rnd.choice(WORDS[s])} were named by name{rnd.randint(0, 99)}." if s else rnd.choice(PLAIN).capitalize() + ".")
    return " ".join(out)


def test_held_out_accuracy(spark):
    rnd = random.Random(3)
    truth = {i: rnd.choice([[1], [2], [3], [1, 2], [2, 3], []]) for i in range(600)}
    docs = spark.createDataFrame([(i, document(rnd, a, rnd.randint(2, 9)), "s") for i, a in truth.items()] + [(900, None, "s"), (901, "", "s"), (902, "no end here", "s"), (None, "The judge spoke.", "s"), (0, None, "s")], "doc_id long, text string, source string")
    wrong = lambda s: rnd.choice([1, 2, 3]) if rnd.random() < 0.04 else s
    labels = spark.createDataFrame([(i, wrong(s)) for i, a in truth.items() if i % 2 for s in (a or [None])] + [(1, s) for s in truth[1]] + [(999, 1), (None, 2)], "doc_id long, subject_id int")
    names = spark.createDataFrame([(1, "science"), (2, "law"), (3, "sport"), (4, "unseen"), (None, "x"), (5, None)], "subject_id int, name string")
    got = {}
    found = subjects.document_subjects(docs, labels, names)
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    name = {1: "science", 2: "law", 3: "sport"}
    tp = fp = fn = 0
    for i in range(0, 600, 2):  # not labelled
        want, have = {name[s] for s in truth[i]}, got.get(i, set())
        tp, fp, fn = tp + len(want & have), fp + len(have - want), fn + len(want - have)
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.9
    assert not {900, 901, 902, None} & set(got)
    assert sum(r.docs for r in subjects.composition(found, docs).collect()) == sum(len(v) for v in got.values())


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "The judge spoke.")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject_id int")
    names = spark.createDataFrame([(1, "law")], "subject_id int, name string")
    assert subjects.document_subjects(docs, labels, names).count() == 0
    only = spark.createDataFrame([(1, None)], "doc_id long, subject_id int")
    assert subjects.document_subjects(docs, only, names).count() == 0
    assert subjects.document_subjects(docs.limit(0), labels, names).count() == 0


def test_sentences():
    assert subjects.sentences("# Head\n\nDear X,\n\nOn 4. Mai it came. Then 1999. Next\r\nline!  \n\nYours") == ["On 4. Mai it came.", "Then 1999.", "Next\nline!"]
    assert subjects.sentences("- One. Two.\n- Three.") == ["One.", "Two.", "Three."] and subjects.sentences(None) == [] and subjects.sentences("x") == []
    assert len(subjects.sentences("A word stands here. " * 20_000)) == 20_000


def test_long_repeated_sentences_dont_explode_and_repeats_keep_their_weight(spark):
    long = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)).replace("word", "long") + "."
    rows = [(i, long, [1]) for i in range(50)] + [(100 + i, f"The judge and plain{chr(97 + i % 26)} spoke.", [2]) for i in range(60)] + [(200 + i, f"Nothing was said by plain{chr(97 + i % 26)}.", []) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, s) for i, _, ss in rows for s in (ss or [None])], "doc_id long, subject_id int")
    found = {(r.doc_id, r.subject) for r in subjects.document_subjects(docs, labels, spark.createDataFrame([(1, "a"), (2, "b")], "subject_id int, name string")).collect()}
    assert found == {(i, "a" if i < 100 else "b") for i, _, ss in rows if ss}


def test_a_subject_that_only_stands_beside_others_is_found(spark):
    rnd = random.Random(5)
    truth = {i: [1, 2] if i % 3 == 0 else [1] if i % 3 == 1 else [] for i in range(900)}
    docs = spark.createDataFrame([(i, document(rnd, a, 6)) for i, a in truth.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, s) for i, a in truth.items() if i % 2 for s in (a or [None])], "doc_id long, subject_id int")
    names = spark.createDataFrame([(1, "science"), (2, "law")], "subject_id int, name string")
    found = {(r.doc_id, r.subject) for r in subjects.document_subjects(docs, labels, names).collect()}
    want = {(i, {1: "science", 2: "law"}[s]) for i, a in truth.items() for s in a}
    assert len(found & want) / len(want) > 0.9 and len(found & want) / len(found) > 0.9


def test_sample_stays_at_its_bound(spark):
    docs = spark.createDataFrame([(i, "The judge spoke.") for i in range(101)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(101)], "doc_id long, subject_id int")
    assert subjects.labelled_sentences(docs, labels, 100).select("doc_id").distinct().count() == 100


def test_pairs_of_a_sentence_are_counted_at_once(monkeypatch):
    import numpy as np
    import pandas as pd

    made, full = [], np.full
    monkeypatch.setattr(subjects.np, "full", lambda *a: made.append(a) or full(*a))
    rank = {f"w{i}": i for i in range(300)}
    rows = pd.DataFrame({"words": [[f"w{i}" for i in range(200)], ["w1", "w7", "x"], ["w0"], [f"w{i}" for i in range(300)]], "subjects": [[1, 2], [], [1], [3]], "weight": [1.0, 2.0, 1.0, 1.0]})
    got = {}
    for part in subjects._pair_counts(iter([rows.iloc[:3]]), rank):
        got |= {(p, c): k for p, c, k in part.itertuples(index=False)}
    want = {((i << 32) + j, c): 0.5 for i in range(200) for j in range(i) for c in (1, 2)} | {((7 << 32) + 1, -1): 2.0}
    assert got == want and len(made) <= 20  # more than 800 arrays before
    long = pd.concat(list(subjects._pair_counts(iter([rows.iloc[3:]]), rank)))  # word by word
    assert len(long) == 300 * 299 // 2 and set(long["k"]) == {1.0}


def test_evidence_of_pairs_asks_only_for_pairs_that_are_there():
    rules = subjects.Rules({"a": {1: 1.0}, "b": {1: 0.5, 2: 0.25}}, {("a", "b"): {1: 3.0}, ("b", "c"): {2: 2.0}, ("c", "z"): {1: 9.0}})
    rules.pairs = None  # the pairs are found by their first word
    assert dict(rules.evidence({"a", "b", "c", "d"})) == {1: 3.0, 2: 2.0} and dict(rules.evidence({"b"})) == {1: 0.5, 2: 0.25}

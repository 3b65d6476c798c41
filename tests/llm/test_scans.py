import random
import re

import pandas as pd
import pytest

from foliomill.llm import lexicon, scans
from foliomill.llm.trie import Trie

WORDS = "the modest court was removed from carpenter until return short long form note and post trial hand written apprentice number describe evening".split()
TEXT = ["the modest court was removed from the carpenter until the evening", "return the short note and describe the hand-written number 12 on the evening", "the post-trial note of the apprentice was short and long", "Pellositz was removed from the court"] * 3


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_trie_finds_every_candidate(most):
    rnd = random.Random(most)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 7)))
    vocabulary, asked = [word() for _ in range(200)] + [""], [word() + rnd.choice(["", "é"]) for _ in range(120)]
    t = Trie(vocabulary)
    found = t.within(asked, most)
    assert all(sorted(found[w]) == [v for v in t.words if distance(v, w) <= most] for w in asked)


def test_confusions():
    assert scans.explained("modest", "moclest") == 1 and scans.explained("return", "retum") == 1 and scans.explained("number", "nurn6er") == 2
    assert scans.explained("court", "courtx") == 3 and scans.explained("court", "court") == 0
    assert scans.title_of("/x/copy of Ulvdal_Custody-Papers 380.PDF") == ["Ulvdal", "Custody", "Papers"]


def run(spark, records, clean=TEXT):
    r = spark.createDataFrame([(s, i, p, t, lost, "x") for s, i, p, t, lost in records], "src string, rec_id long, file_path string, text string, lost_ends boolean, kind string")
    c = spark.createDataFrame([(t,) for t in clean], "text string")
    return {x.rec_id: (x.text, {(a.kind, a.word) for a in x.repairs}) for x in scans.repair_scans(r, c).collect()}


def test_repairs(spark):
    path = "/d/Tosnix Charter Notes 12.pdf"
    got = run(spark, [
        ("p", 1, path, "# Tosnix Charter Notes\n\nThe moclest court was re-\nmoved from the car-\nTOSNIX CHARTER NOTES\n- 4 -\npenter until the evening.\n\nThe post-\ntrial note. The short-\nand long form.", False),
        ("p", 2, path, "A note\n\nTosnix  Charter Nltes    xiv\n\nof the court.", False),
        ("v", 3, path, "The car- penter was 12 retumed. Tosnix Charter Notes Pello- sitz wos re-moved p. 3 from the hand-written note.", True),
        ("p", 4, path, None, False), ("p", 5, path, "", False), ("p", 6, None, "12\n\n[3]\n\nThe court.", False),
        ("p", 7, path, "The court was removed.\r\n\r\nThe note.", False),
    ])
    assert got[1][0] == "# Tosnix Charter Notes\n\nThe modest court was removed from the carpenter until the evening.\n\nThe post-trial note. The short- and long form."
    assert got[1][1] == {("misread", "modest"), ("hyphen", "removed"), ("hyphen", "carpenter"), ("hyphen", "post-trial"), ("header", ""), ("page_number", "")}
    assert got[2] == ("A note of the court.", {("header", ""), ("page_number", "")})
    assert {("hyphen", "carpenter"), ("header", ""), ("hyphen", "pellositz"), ("misread", "was"), ("hyphen", "removed"), ("page_number", "")} <= got[3][1]
    assert got[4] == (None, set()) and got[5] == ("", set())
    assert got[6] == ("The court.", {("page_number", "")}) and got[7] == ("The court was removed.\n\nThe note.", set())


def test_no_clean_texts_long_text_and_empty_table(spark):
    assert run(spark, [("p", 1, "/a.pdf", "some un-\nknown words\np. 3", False)], [])[1][1] == {("hyphen", "unknown"), ("page_number", "")}
    assert run(spark, []) == {}
    long = run(spark, [("v", 1, "/Tosnix Charter.pdf", "the court 5 was removed " * 20_000, True), ("p", 2, "/a.pdf", "the court was\nremoved\n" * 20_000, False)])
    assert len(long[2][0]) > 300_000 and long[2][1] == set()
    rows = spark.createDataFrame([("p", 1, "/a.pdf", "re-\nmoved", False)] * 2, "src string, rec_id long, file_path string, text string, lost_ends boolean")
    repaired = scans.repair_scans(rows, spark.createDataFrame([(t,) for t in TEXT], "text string"))
    assert [tuple(r) for r in scans.repairs(repaired).collect()] == [("p", 1, "hyphen", "removed")]


def test_header_that_is_not_the_files_name_is_found_by_its_repetition(spark):
    body = lambda i: f"The modest court was removed from the\n{i + 1}   Ledger of the Old Guild\ncarpenter until the evening.\n\nHeads and Tails\n\nReturn the short note."
    rows = [("p", i, "/d/scan 1.pdf", body(i), False, i) for i in range(4)] + [("p", 10 + i, "/d/other.pdf", body(0), False, 7) for i in range(5)]
    r = spark.createDataFrame(rows, "src string, rec_id long, file_path string, text string, lost_ends boolean, place int")
    got = {x.rec_id: x for x in scans.repair_scans(r, spark.createDataFrame([(t,) for t in TEXT], "text string")).collect()}
    assert "Ledger" not in got[0].text and "from the carpenter until" in got[0].text and {("header", ""), ("page_number", "")} <= {(a.kind, a.word) for a in got[0].repairs}
    assert "Heads and Tails" in got[0].text  # repeated, but where headings stand
    assert "Ledger" in got[10].text  # copies of one place are no repetition


def test_rare_words_stay_in_the_vocabulary_however_much_text_there_is(spark):
    words, pairs, _ = scans.clean_words(spark.createDataFrame([("Zylinderkopf was seen twice",)] * 2 + [("the court " * 5000,)] * 300, "text string"))
    assert words["zylinderkopf"] == 2 and words["court"] == 1_500_000  # one of 1.5 million


def test_worker_keeps_what_it_has_learnt():
    class Sent:
        value = ({"court": 3}, {}, set())

    r = scans._repairer("run", Sent)
    assert r.candidates("caurt") == r.memory["caurt"] and scans._repairer("run", Sent) is r and scans._repairer("next", Sent) is not r and len(scans._ready) == 1


def test_vocabulary_beyond_the_bound_is_asked_with_the_same_result(spark, monkeypatch):
    rnd = random.Random(3)
    clean = [" ".join(rnd.choices(WORDS + ["hand-written", "post-trial", "Guild", "house", "horse", "3", "vi"], k=12)) + "." for _ in range(60)]
    spoil = lambda t: t.replace("m", "rn", rnd.randint(0, 1)).replace("e", "c", rnd.randint(0, 2)).replace(" the", " 7 the", rnd.randint(0, 1)).replace("ar", "ar-\n", rnd.randint(0, 1))
    rows = [("p", i, "/d/Old Guild 3.pdf", spoil(t), i % 2 == 1, i) for i, t in enumerate(clean)] + [("p", 90, None, None, False, 1), ("p", 91, "/a.pdf", "", True, None), ("p", 0, "/d/x.pdf", "houso 5 6 the", True, 0)]
    r = spark.createDataFrame(rows, "src string, rec_id long, file_path string, text string, lost_ends boolean, place int")
    c = spark.createDataFrame([(t,) for t in clean], "text string")
    got = lambda **k: sorted((x.rec_id, x.text or "", sorted(map(tuple, x.repairs))) for x in scans.repair_scans(r, c, **k).collect())
    monkeypatch.setattr(lexicon, "BLOCK_CHARS", 1500)
    monkeypatch.setattr(lexicon, "SHARD_WORDS", 3)
    monkeypatch.setattr(lexicon, "SHARD_ASKED", 2)
    whole = got()
    assert sum(len(x[2]) for x in whole) > 30 and got(most=5) == whole
    assert scans.repair_scans(r.limit(0), c, most=5).collect() == []


def test_candidates_of_shards_are_those_of_one_trie(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("celi1ocdrnm") for _ in range(rnd.randint(1, 6)))
    vocabulary, asked = {word() for _ in range(150)}, {word() for _ in range(60)} | {"x" * 50}
    seen = spark.createDataFrame([(w, 2, 1) for w in sorted(vocabulary)], "w string, n long, k long")
    keys = spark.createDataFrame([(w,) for w in sorted(asked)], "key string")
    got = {(x.key, x.word, x.confusions) for x in lexicon.candidates(keys, seen, 20, 7).collect()}
    near = Trie(list(w for w in vocabulary if not any(c.isdigit() for c in w))).within(list(asked), scans.EDITS)
    assert got == {(w, v, scans.explained(v, w)) for w, vs in near.items() for v in vs if v != w and scans.explained(v, w) <= scans.CONFUSIONS_MOST}


def test_tokens_in_order_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

    words = Counted({w: 2 for w in WORDS})
    text = "The modest court, removed by Pellositz (12) from the carpenter."
    b = pd.DataFrame({"src": "p", "rec_id": range(300), "file_path": "/a.pdf", "text": text, "lost_ends": False, "running": None})
    r = scans.Repairer(words, {}, set())
    assert set(scans.repair_batch(r, b)["text"]) == {text}
    words.asked = 0
    assert set(scans.repair_batch(r, b)["text"]) == {text} and words.asked == 0



def test_fast_patterns_find_what_the_plain_ones_do():
    rnd = random.Random(6)
    bits = ["p.", "P", "Page", " ", " ", "  ", "\n", "-", "‐", "\xad", "7", "12", "12345", "/", "[", "]", "of", "Chapter", "Teil", "I", "a", "é", ".", "~", "_", "\x01", "The", "court"]
    inline, broken, soft = re.compile(rf"(?:(?<=\s)|^){scans._NUMBER}(?=\s|$)"), re.compile(r"(?<=[^\W\d_])[-‐¬\xad] (?=[^\W\d_])"), re.compile(r"(?<=[^\W\d_])[‐¬\xad](?=[^\W\d_])")
    found = [0] * 4
    for _ in range(20_000):
        t = "".join(rnd.choices(bits, k=rnd.randint(1, 12)))
        for n, (plain, fast) in enumerate(((inline, scans._INLINE), (broken, scans._BROKEN), (soft, scans._SOFT))):
            want = [m.span() for m in plain.finditer(t)]
            assert want == [m.span() for m in fast.finditer(t)], (t, plain)
            found[n] += len(want)
        want = [m.span(3) for m in scans._SECTION.finditer(t)]
        assert want == [m.span(3) for s in scans._SECTION_START.finditer(t) if (m := scans._SECTION.match(t, s.start()))], t
        found[3] += len(want)
    assert min(found) >= 10


def test_near_is_the_distance():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abc", k=rnd.randint(0, 9)))
    assert all(scans._near(a, b, most) == (distance(a, b) <= most) for a, b, most in ((word(), word(), rnd.randint(0, 4)) for _ in range(20_000)))

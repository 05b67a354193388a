import tracemalloc

import numpy as np
import pytest

from tagweave.llm import sentences as S, subjects as J
from tagweave.llm.characters import CJK, THAI, Characters, units

DOCUMENTS = "doc_id long, text string, start_char string, h string"
ANNOTATED = "id string, text string, tokens array<struct<text:string,sentence_index:int>>"

EN = ["Send approx. 21.1 sheets, e.g. the request, to Dept. 41 of Traemuno.", "Who has seen the file?!", "The clerk replies: \"The register page is missing.\"", "“Send the list back!” says the clerk, “or we will close it.”",
      "The desk opens at 8 a.m. and takes the file until 5 p.m.", "(The plain file stays open for 46 days.)", "The clerk waits for the file ... and then calls Drala.", "In parallel, the deputy stamps the form.",
      "See Fig. 40 and sec. 20.3 of the manual.", "eForm 35 for the file is stored under Bar.", "The tray holds the form, old labels, etc."]
DE = ["Gemäß Abs. 70 bzw. Anlage A wird die Kette freigegeben.", "„Ist die Notiz vollständig?“, fragt die Leitung am 62. Tag.", "Danach geht die Akte an die Stelle B, z. B. zusammen mit Nr. 50 der Akte.", "Wer hat die Anfrage verglichen?"]
ZH = ["根据第45.89条，先批准表格，再处理便条。", "值班员说：“请把表格交给他。”", "“清单齐全了吗？”负责人在第36天问道。", "谁把记录作了比较？"]
TH = ["ห้องเก็บข้อผิดพลาดและกิ่งรีลีส", "ใครเปรียบเทียบแฟ้มแล้วหรือยัง?", "จากนั้นส่งแฟ้มไปยังหน่วยในเวลา45.20ชั่วโมง"]
HI = ["नियम सं. 73 के अनुसार विभाग फ़ाइल स्वीकार करता है।", "“फ़ाइल कहाँ है?” शाखा 20 दिन बाद पूछती है।", "क्या सूची और फ़ाइल का मिलान हुआ?"]


def make(rng, n):
    out = []
    for _ in range(n):
        lines, gap = [(EN, " "), (DE, " "), (ZH, ""), (TH, " "), (HI, " ")][rng.integers(5)]
        own = [str(x) for x in rng.choice(lines, rng.integers(2, 8))]
        text, cuts = "", []
        if rng.random() < 0.3:
            text, cuts = "Scope and purpose\n\n", ["Scope and purpose"]
        wrapped = gap and rng.random() < 0.3
        for k, s in enumerate(own):
            if wrapped:  # a line break in place of a blank, anywhere
                at = [i for i, ch in enumerate(s) if ch == " " and i > 3]
                i = at[rng.integers(len(at))] if at else None
                s = s if i is None else s[:i] + "\n" + s[i + 1 :]
            if rng.random() < 0.15 and gap:
                s = f"{k + 1}. {s}"
                text = text.rstrip(" ") + ("\n" if text and not text.endswith("\n") else "")
            text += s + (rng.choice([gap, gap, "\n\n"]) if k < len(own) - 1 else "")
            cuts.append(s)
        out.append((text, cuts))
    return out


def cut_texts(model, texts):
    t, a, b = S.cut(model, Characters(texts))
    out = [[] for _ in texts]
    for i, x, y in zip(t, a, b):
        out[i].append(texts[i][x:y])
    return out


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    texts = [t for t, _ in make(rng, 500)]
    c = S.candidates(Characters(texts))
    y = S.rule_labels(c)
    more = list(S.stripped(c, y, texts))
    return S.train([c, *(x for x, _ in more)], [y, *(x for _, x in more)])


def test_held_out_texts(model):
    held = make(np.random.default_rng(1), 200)
    found = cut_texts(model, [t for t, _ in held])
    right = sum(set(f) == set(c) for f, (_, c) in zip(found, held))
    assert right >= 190


def test_odd_texts(model):
    texts = ["", "   ", "\n\n\n", "no end", ".", "...", "?! ?!", "a.\x00b. C", " Tail. \n", "x" * 200_000 + ". Next one.", "One. Two.\r\n\r\nThree"]
    found = cut_texts(model, texts)
    assert found[0] == found[1] == found[2] == [] and found[3] == ["no end"] and found[8] == ["Tail."]
    assert "Three" in found[10] and all(s == s.strip() and s for f in found for s in f)


def test_wrapped_lines_and_glued_sentences(model):
    assert cut_texts(model, ["In parallel, the deputy\nstamps the form. Who has seen\nthe file?!"])[0] == ["In parallel, the deputy\nstamps the form.", "Who has seen\nthe file?!"]
    assert cut_texts(model, ["The clerk stamps the form.In parallel, the deputy stamps the form."])[0] == ["The clerk stamps the form.", "In parallel, the deputy stamps the form."]


@pytest.mark.parametrize("mark", [".", ""])
@pytest.mark.parametrize("after", [". ", ") "])
def test_long_lists(model, mark, after):
    items = [f"{k}{after}The deputy stamps the form{mark}" for k in range(1, 121)]
    c = S.candidates(Characters(["\n".join(items)]))
    labels = S.rule_labels(c)
    assert set(c.start[labels].tolist()) == {i + 1 for i in np.cumsum([len(x) + 1 for x in items[:-1]])}
    assert cut_texts(model, ["\n".join(items)])[0] == items
    assert cut_texts(model, ["\n".join(items[100:])])[0] == items[100:]


def test_shortened_words_are_learned():
    text = " ".join(f"The clerk of Brontun Ltd. Dispatch sends approx. {k} sheets to St. Tomer{k}. The form is old, etc. The form stays. Then the form waits for the form." for k in range(20))
    own = S.habits(S.candidates(Characters([text])))
    assert {"ltd", "approx", "st"} <= own.short and "form" not in own.short and not {"ltd", "approx"} & own.ending


def test_ideographs_without_marks_are_cut(model):
    first, second = ZH[0].rstrip("。").replace("，", ""), "谁把记录作了比较"
    c = S.candidates(Characters([first + second, ZH[0] + second]))
    assert (c.text == 0).sum() > 10 and (c.text == 1).sum() < 4
    y = S.rule_labels(S.candidates(Characters([ZH[0] + ZH[3]])))
    (spaced, a), (joined, b) = S.stripped(S.candidates(Characters([ZH[0] + ZH[3]])), y, [ZH[0] + ZH[3]])
    assert a.sum() == b.sum() == 1 and len(b) > 10
    assert joined.end[b][0] == 1 + sum(ch not in "。.？" for ch in ZH[0])


def test_metadata_are_used_where_they_tell():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 200)
    given = np.eye(3, dtype=bool)[truth]
    given[120:] = False
    site = ["law", "sport", "science"]
    telling = [J.metadata_parts([f"{site[t if rng.random() < 0.9 else rng.integers(3)]}.example/page/{i}", None, "news"]) for i, t in enumerate(truth)]
    likely, gain = J.metadata_prior(telling, given)
    assert gain > 0.3 and (likely.argmax(1)[120:] == truth[120:]).mean() > 0.8 and np.allclose(likely.sum(1), 1)
    none, gain = J.metadata_prior([J.metadata_parts([site[rng.integers(3)], None, None]) for _ in truth], given)
    assert none is None and gain < 0.05
    assert J.metadata_prior([set()] * 5, np.zeros((5, 3), bool)) == (None, 0.0)


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(2)
    c = S.candidates(Characters(["a. b. c. d. e.\nf. G", "H. i! J", "none"]))
    w, pairs = np.zeros(S.WIDTH), rng.normal(size=(3, 2, 2))
    f = S.features(c)
    w[np.unique(f)] = rng.normal(size=len(np.unique(f)))
    tags = S.Model(w, pairs).decode(c)
    score, far = w[f].sum(1) + 30.0 * (c.newlines >= 2), S._distance(c)
    for text in np.unique(c.text):
        at = np.flatnonzero(c.text == text)

        def value(bits):
            total = sum(score[i] for i, x in zip(at, bits) if x)
            return total + sum(pairs[far[i], x, y] for i, x, y in zip(at[1:], bits, bits[1:]))

        every = [[int(x) for x in f"{k:0{len(at)}b}"] for k in range(1 << len(at))]
        assert max(every, key=value) == tags[at].astype(int).tolist()


def test_tables(spark):
    rng = np.random.default_rng(5)
    data = [(i, t, None, None) for i, (t, _) in enumerate(make(rng, 60))] + [(100, None, None, None), (101, "", None, None), (None, "No id. Here.", None, None)]
    docs = spark.createDataFrame(data, DOCUMENTS)
    notes = spark.createDataFrame([("a", "One two. Three.", [("One", 0), ("two", 0), (".", 0), ("Three", 1), (".", 1)]), ("b", None, None), ("c", "x", [("x", None)])], ANNOTATED)
    spans = S.sentence_spans(docs, S.fit(docs, notes)).collect()
    assert {r.doc_id for r in spans} == {None, *range(60)} and all(r.start_char < r.end_char for r in spans)
    empty = S.sentence_spans(docs.limit(0), S.fit(docs.limit(0), notes.limit(0)))
    assert empty.count() == 0


def test_every_text_is_trained_on(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('The clerk waits for form ', id, '. The form stays.') as text")
    notes = docs.selectExpr("cast(doc_id as string) as id", "'One. Two.' as text", "array(named_struct('text', 'One.', 'sentence_index', 0), named_struct('text', 'Two.', 'sentence_index', 1)) as tokens")
    monkeypatch.setattr(S, "train", lambda parts, labels: parts)
    plain, *_, loud, known = S.fit(docs, notes)
    assert [len(c.chars.starts) for c in (plain, loud, known)] == [3000] * 3
    assert (plain.weight, loud.weight) == (1.0, S.LOUD) and known.weight * 3000 == pytest.approx(S.KNOWN * 3000)


def test_tasks_learn_what_the_driver_does(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [t for t, _ in make(rng, 200)] + [f"Sent to St. Tomer{k} of Ltd. Dispatch by the clerk. The old form, etc. The form is ca. {k} long." for k in range(20)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)] + [(None, None, None, None)], DOCUMENTS).repartition(3)
    notes = spark.createDataFrame([("a", "One two. Three.", [("One", 0), ("two", 0), (".", 0), ("Three", 1), (".", 1)]), ("b", None, None)], ANNOTATED)
    one = S.fit(docs, notes)
    found, own = S.table_habits(docs.where("text is not null").select("text"), S.Scratch(spark, "test")), S.habits(S.candidates(Characters(texts)))
    assert found == own and own.short and own.ending | own.counted
    monkeypatch.setattr(S, "LOCAL", sum(map(len, texts)) // 3)
    monkeypatch.setattr(S, "BLOCK", 3000)
    seen = cut_texts(S.fit(docs, notes), texts)
    assert sum(a == b for a, b in zip(seen, cut_texts(one, texts))) >= 0.98 * len(texts)
    monkeypatch.setattr(S, "PARTS", 1)
    same = S.fit(docs, notes)
    assert np.allclose(same.weights, one.weights, atol=1e-4) and np.allclose(same.pairs, one.pairs, atol=1e-4)


def test_a_round_takes_few_tasks(spark):
    texts = [t for t, _ in make(np.random.default_rng(5), 70)]
    whole, kept = np.zeros(S.WIDTH + 13), []
    for k in range(0, 70, 10):
        c = S.candidates(Characters(texts[k : k + 10]))
        x = S.chains(c, S.rule_labels(c))
        S.gradient(x, np.zeros(S.WIDTH), np.zeros((3, 2, 2)), whole)
        kept.append((x.weight, *(bytearray(getattr(x, n).tobytes()) for n in S._STORED)))
    part = spark.createDataFrame(spark.sparkContext.parallelize(kept, 7), S._CHAINS.removesuffix(", part int"))
    spark.sparkContext.setJobGroup("few tasks", "")
    assert np.allclose(S._table_gradient([part])(1, np.zeros(S.WIDTH), np.zeros((3, 2, 2))), whole)
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [seen.getStageInfo(s).numTasks for j in seen.getJobIdsForGroup("few tasks") for s in seen.getJobInfo(j).stageIds] == [3]


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_gradient_matches_enumeration(monkeypatch, stretch):
    monkeypatch.setattr(S, "STRETCH", stretch)
    rng = np.random.default_rng(4)
    c = S.candidates(Characters(["a. b. c. d. e.\nf. G", "none", "H. i! J"]))
    w, pairs, labels = rng.normal(size=S.WIDTH), rng.normal(size=(3, 2, 2)), rng.random(len(c.end)) < 0.5
    f, far, expected = S.features(c), S._distance(c), np.zeros(S.WIDTH + 13)
    expected[-1] = len(c.end)
    for text in np.unique(c.text):
        at = np.flatnonzero(c.text == text)
        every = [[int(x) for x in f"{k:0{len(at)}b}"] for k in range(1 << len(at))]
        value = np.array([sum(w[f[i]].sum() for i, x in zip(at, y) if x) + sum(pairs[far[i], a, b] for i, a, b in zip(at[1:], y, y[1:])) for y in every])
        chance = np.exp(value - value.max()) / np.exp(value - value.max()).sum()
        for y, p in [*zip(every, chance), (labels[at].astype(int).tolist(), -1)]:
            for i, x in zip(at, y):
                np.add.at(expected, f[i].astype(int), p * x)
            for i, a, b in zip(at[1:], y, y[1:]):
                expected[S.WIDTH + 4 * far[i] + 2 * a + b] += p
    total = np.zeros(S.WIDTH + 13)
    S.gradient(S.chains(c, labels), w, pairs, total)
    assert np.allclose(total, expected)


def test_units_have_the_same_hash_anywhere():
    u = units(Characters(["Apple pie", "my APPLE", "苹果x苹", "ก ข"]), (CJK, THAI))
    h = {(t, s): v for t, s, v in zip(u.text.tolist(), (u.start).tolist(), u.hash.tolist())}
    values = list(h.values())
    assert values[0] == values[3] and values[4] == values[7] and len(values) == 10


NOUNS = {"law": ["verdict", "bailiff", "statute", "affidavit"], "sport": ["goalkeeper", "referee", "marathon", "league"], "science": ["spectrum", "microscope", "enzyme", "hypothesis"]}


def documents(rng, n):
    out = []
    for i in range(n):
        own = list(rng.choice(list(NOUNS), size=rng.choice([0, 1, 2], p=[0.1, 0.7, 0.2]), replace=False))
        lines = []
        for _ in range(12):
            if own and rng.random() < 0.85:
                noun = rng.choice(NOUNS[rng.choice(own)])
                lines.append(f"The {rng.choice(['old', 'new', 'late'])} {noun} is {rng.choice(['checked', 'sent', 'filed'])} before noon.")
            else:
                lines.append(f"The {rng.choice(['form', 'ticket', 'folder'])} is {rng.choice(['checked', 'sent', 'filed'])} before noon.")
        out.append((i, " ".join(lines), own))
    return out


def test_subjects_of_held_out_documents(spark):
    rng = np.random.default_rng(7)
    data = documents(rng, 260)
    docs = spark.createDataFrame([(i, t, None, None) for i, t, _ in data] + [(900, None, None, None), (901, "", None, None), (902, "Overview", None, None)], DOCUMENTS)
    labels = spark.createDataFrame([(i, (own[0] if rng.random() < 0.93 else "law"), "r") for i, _, own in data[:90] if own] + [(5000, "law", "r"), (None, "law", "r"), (1, None, "r"), (2, "unheard", "r")], "doc_id long, subject string, rater string")
    areas = spark.createDataFrame([(s, f"{s}: {' '.join(n)}") for s, n in NOUNS.items()] + [("law", None)], "subject string, description string")
    boundaries = S.fit(docs, None)
    found = J.document_subjects(docs, J.fit(docs, labels, areas, boundaries)).collect()
    got = {(r.doc_id, r.subject) for r in found}
    held = {i: set(own) for i, _, own in data[90:]}
    clear = {(i, s) for i, own in held.items() for s in own if len(own) == 1}
    assert len(clear & got) >= 0.95 * len(clear)
    assert len({(i, s) for i, s in got if i in held and s not in held[i]}) <= 0.03 * len(held)
    assert not {i for i, _ in got} & {900, 901, 902}
    assert J.document_subjects(docs.limit(0), J.fit(docs.limit(0), labels.limit(0), areas, S.fit(docs.limit(0), None))).count() == 0


def test_training_holds_no_more_than_the_n_grams_that_occur(monkeypatch):
    monkeypatch.setattr(J, "ROUNDS", 5)
    data = documents(np.random.default_rng(8), 300)
    given = np.array([[s in own and i < 150 for s in [*NOUNS, "d", "e", "f", "g", "h"]] for i, _, own in data])
    whole, few, sliced = (J.sentences_of([t.replace(". ", ".\n\n") for _, t, _ in data], S.Model(np.zeros(S.WIDTH), np.zeros((3, 2, 2)))) for _ in range(3))
    few.only_frequent(1)
    assert few.width == len(np.unique(whole.grams)) and np.array_equal(few.used[few.grams], whole.grams)
    tracemalloc.start()
    labels = J.weak_labels(few, given, 8)
    weights, intercepts = J.train(few, labels[:, :-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6  # of which the weights are 8 MB
    for size, s in ((1 << 30, whole), (50, sliced)):
        monkeypatch.setattr(J, "SLICE", size)
        monkeypatch.setattr(J, "SENTENCES", min(size, 7))
        assert len(list(s.slices())) == (1 if s is whole else 300)
        assert np.array_equal(J.weak_labels(s, given, 8), labels)
        assert np.array_equal(J.train(s, labels[:, :-1])[0], weights)
    assert np.abs(weights).max() > 0 and labels[:, :3].sum() > 100


def test_samples_hold_whole_texts(spark, monkeypatch):
    text = "The clerk stamps the form. " * 2000
    docs = spark.createDataFrame([(1, text, "a", None)], DOCUMENTS)
    monkeypatch.setattr(S, "train", lambda parts, labels: parts)
    assert len(text) == len(S.fit(docs, None)[0].chars.codes) - 2
    seen = []
    monkeypatch.setattr(J, "Sentences", lambda texts, boundaries: seen.extend(texts) or 1 / 0)
    labels, areas = spark.createDataFrame([(1, "Law")], "doc_id long, subject string"), spark.createDataFrame([("Law", "law")], "subject string, description string")
    with pytest.raises(ZeroDivisionError):
        J.fit(docs, labels, areas, None)
    assert seen == [text, "law"]

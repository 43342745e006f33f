"""Sentences of hand-cut texts; positions by code points."""

import pytest

from tidewheel.llm.sentences import sentence_spans, sentences

SCHEMA = "doc_id bigint, text string, lang string, start_pos string, base int, line string, m string"

# Each line: the sentences that it must be cut into; joined by a blank unless the first item says otherwise.
CASES = [
    ["Dr. Smith met Mr. and Mrs. Jones at 5 p.m. on Mill St. in town.", "They left at 3.30, i.e. early."],
    ["It dates to the 2nd c. B.C.", "The U.N.E. rules apply, cf. fig. 4.2, vs. No. 5 of vol. 3, pp. 4–9."],
    ["J. R. Doe (b. 1901) kept it for 5 yrs. before it was sold!", "Why?", "No one knows...", "Really?!"],
    ["He asked: “Is this the barn?”", "“Who would have sold it?” asked Doe, then aged 5.", "(It burned down in 1900.)", "eLoft X, a mill, was closed."],
    ["Prof. Doe wrote that “it cannot be named. It must be sold.”", "A harbour … was found, and nobody left.", "The band Hey! toured."],
    ["See www.csv.example, or [[Main. Page (x. y)|there]]; use {{convert|4.5|km}} now.<ref>''Annals'', vol. 4, p. 5. Ed.</ref>", "Next."],
    ["Der Turm (vgl. S. 9 ff.) gehört z. B. zur Familie Doe.", "Am 3. Mai 1901 kam Dr. Doe, usw. im 19. Jahrhundert.", "„Er bleibt. Er geht nicht“, sagte Doe."],
    ["Av. J.-C., le lieu s’appelait Rack.", "« Nous partons. Il reste », écrit M. Doe.", "« Il est perdu ! » s’écria Mme Doe.", "Où est-il ?", "Là."],
    ["El Sr. Doe dijo, p. ej. hoy: «No se vende. Se cuida».", "¡Nunca!", "¿Quién?", "La empresa X S. A. compró la Av. Y, núm. 5."],
    ["В 1820 г. здесь жило 5 чел., т. е. мало.", "Он сгорел в 1762 г.", "«Где же он?» — спросил А. В. Иванов.", "Ул. Мира, д. 5, пустует…", "Позже всё."],
    ["Πότε άνοιξε;", "Ο κ. Α ζει, π.χ. εδώ· το 1900 π.Χ. ήταν."],
    ["Գյուղը 1900 թ. գարնանը։", "Ո՞վ վաճառեց այն։", "«Կմնա։ Կպահպանենք»,— ասաց նա։"],
    ["“यह कहाँ है?” नाद ने पूछा।", "नाद ने कहा, “नहीं बिकेगा। बचाएँगे।”", "1.5 वर्ग कि.मी. है और डॉ. नाद हैं।", "क्या यह है?"],
    ["قال د. نادر: «لن تباع. سنحميها».", "من باع؟", "احترقت عام 1812 م. تقريبًا، ثم رممت!", "كانت مهجورة…", "هي 1.5 كم²."],
    # months, titles and short forms of more languages; behind a name they may end a sentence too
    ["On Jan. Fifth the Univ. Press of Exeter moved.", "Acme Corp. Holdings and John Doe Jr. Smith stayed.", "It was bought by John Doe Jr. in 1950.", "He left it to James Roe Jr.", "The mill closed."],
    ["Il sig. Rossi e la dott. Bianchi restano.", "Poi vanno via."],
    ["O Exmo. Senhor Silva falou.", "Ele saiu."],
    ["Dhr. Jansen en Mevr. Smit wonen hier.", "Zij blijven."],
    # scripts with full stops of their own
    ["ይህ ቤት ነው።", "ያ ዛፍ ነው።", "ማን መጣ፧"],
    ["ဒါက အိမ် ဖြစ်သည်။", "သူ လာသည်။"],
    ["នេះជាផ្ទះ។", "គាត់មក។"],
    ["འདི་ཁང་པ་ཡིན།", "ཁོ་ཡོང་གི་རེད།"],
]
GLUED = [
    ["它在哪里。", "“在哪里？”他问道。", "他说：“不能卖。要保护。”", "叫《桥。事》，流传。", "宽14.70km……", "谁？", "有（又名。某）的！"],
    ["誰が？", "「どこ。」と彼は言った。", "彼は「残る。必ず」と書く。", "Ver.63.1の図！", "橋（旧称。今）は焼失した。"],
    ["It was sold.", "The mill stood.", "J. R. Doe left."],
    ["वह गया!", "क्या यह है?", "हाँ।"],
]
THAI = [["วัดอยู่ใกล้", "มีพื้นที่ 29.9 ตาราง 5 คน", "เขากล่าวว่า“อยู่ ต่อไป”แล้วไป"]]


def cut(spark, text):
    df = spark.createDataFrame([(1, text, "xx", "a", 5, "b", "c")], SCHEMA)
    rows = sorted(sentences(df).collect(), key=lambda r: r.start_pos)
    for r in rows:
        assert text[r.start_pos : r.end_pos] == r.sentence
    return [r.sentence for r in rows]


@pytest.fixture(scope="module")
def cut_all(spark):
    texts = [" ".join(c) for c in CASES + THAI] + ["".join(c) for c in GLUED]
    df = spark.createDataFrame([(i, t, "xx", "a", 5, "b", "c") for i, t in enumerate(texts)], SCHEMA)
    out = {i: [] for i in range(len(texts))}
    for r in sorted(sentences(df).collect(), key=lambda r: (r.doc_id, r.start_pos)):
        out[r.doc_id].append(r.sentence)
    return out


@pytest.mark.parametrize("i", range(len(CASES) + len(THAI) + len(GLUED)))
def test_cases(cut_all, i):
    assert cut_all[i] == (CASES + THAI + GLUED)[i]


def test_lines_and_markup(spark):
    text = "\n".join(
        ["#REDIRECT [[X]]", "#WEITERLEITUNG [[Y]]", "{{Box", "| a = B. C.", "}}", "== Head. Line ==", "{| class", "! x. Y", "|}", "<!-- A. B. -->", "----", "[[File:a.jpg|thumb|Old [[b]]. New.]]", "", "  ", "* One. Two", "** 😂😂 three", "# Four!", ": Five", "[[Link]] begins. It ends", "smells :)", "1) One. 2) Two"]
    )
    assert cut(spark, text) == ["One.", "Two", "😂😂 three", "Four!", "Five", "[[Link]] begins.", "It ends", "smells :)", "1) One.", "2) Two"]


def test_capitals(spark):
    text = "THE ST. X PAPERS, ED. BY Y, HOLDINGS INC. AND MR. Z, E.G. NO. 5. IT WAS FOUND … BY ALL. “WHAT? NO.”"
    assert cut(spark, text) == ["THE ST. X PAPERS, ED. BY Y, HOLDINGS INC. AND MR. Z, E.G. NO. 5.", "IT WAS FOUND … BY ALL.", "“WHAT? NO.”"]


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, "ab  cd. Ce de."), (5, "Ab bc. Cd de."), (5, "Ab bc. Cd de."), (6, "((((" * 300 + " xy. Yz"), (7, "“open. Never closed"), (None, "One. Two.")]
    df = spark.createDataFrame([(i, t, "", "", 1, "", "") for i, t in rows], SCHEMA)
    got = {}
    for r in sentence_spans(df).collect():
        got.setdefault(r.doc_id, set()).add((r.start_pos, r.end_pos))
    assert got[5] == {(0, 6), (7, 13)}
    assert 1 not in got and 2 not in got and 3 not in got
    assert got[4] == {(0, 7), (8, 14)}
    assert got[7] == {(0, 6), (7, 19)} and len(got[6]) == 2 and len(got[None]) == 2
    assert sentence_spans(df.where("false")).count() == 0


def test_positions_in_texts_of_many_lines(spark):
    text = "\n".join(f"Line {i} ends. So does {'x' * (i % 7)} this" for i in range(1500))
    df = spark.createDataFrame([(1, text, "", "", 1, "", ""), (2, text[:9000], "", "", 1, "", "")], SCHEMA)
    got = [r.sentence for r in sorted(sentences(df).where("doc_id = 1").collect(), key=lambda r: r.start_pos)]
    assert got == [s for i in range(1500) for s in (f"Line {i} ends.", f"So does {'x' * (i % 7)} this")]
    long_line = " ".join(f"Mill {i} was sold." for i in range(3000))
    assert cut(spark, long_line) == [f"Mill {i} was sold." for i in range(3000)]


def test_very_long_line(spark):
    text = "The mill was sold in 1900. " * 4000 + "X" + "x" * 200_000
    df = spark.createDataFrame([(1, text, "", "", 1, "", "")], SCHEMA)
    assert sentence_spans(df).count() == 4001

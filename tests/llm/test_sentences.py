"""Sentence units on small fixtures."""

import pytest

from wayflow.llm import sentences

CASES = [
    ("One. Two? Three!", ["One.", "Two?", "Three!"]),
    ("As Dr. Vintra et al. noted, it is 3.5 K vs. 4~K. So what?! See Fig. 4, cf. Eq. (5) and Sec. 4.1. Done", ["As Dr. Vintra et al. noted, it is 3.5 K vs. 4~K.", "So what?!", "See Fig. 4, cf. Eq. (5) and Sec. 4.1.", "Done"]),
    ("J.~K. Telmiq and A.N. Ostwin ran at 9 a.m. and again at 4 p.m. by car. In the U.S. data it holds.", ["J.~K. Telmiq and A.N. Ostwin ran at 9 a.m. and again at 4 p.m. by car.", "In the U.S. data it holds."]),
    ("He asked ``Why? Is it so?'' and left. “The sensor works.” (It is gradual.) End.", ["He asked ``Why? Is it so?'' and left.", "“The sensor works.”", "(It is gradual.)", "End."]),
    ("It holds\\footnote{See App.~B for x.}. The $f(n)=\\frac{1}{n!}$ grows. It rose by 2\\,\\% now.", ["It holds\\footnote{See App.~B for x.}.", "The $f(n)=\\frac{1}{n!}$ grows.", "It rose by 2\\,\\% now."]),
    ("Am 14. Oktober, z. B. bei 6,6 °C, d. h. mehr. Dr. X schrieb: „Alles bricht!“ und ließ es. Ca. 3 aus Nr. 9 usw. in jeder.", ["Am 14. Oktober, z. B. bei 6,6 °C, d. h. mehr.", "Dr. X schrieb: „Alles bricht!“ und ließ es.", "Ca. 3 aus Nr. 9 usw. in jeder."]),
    ("M. Sirque note que « tout tarde ! » sans citer. On obtient 6 mm, c.-à-d. moins, cf. éq. 39. Oui ?", ["M. Sirque note que « tout tarde ! » sans citer.", "On obtient 6 mm, c.-à-d. moins, cf. éq. 39.", "Oui ?"]),
    ("«¿Qué es este?», preguntó la Dra. Telmiq. Tardó 7.10 s, p. ej. con él, aprox. lo previsto.", ["«¿Qué es este?», preguntó la Dra. Telmiq.", "Tardó 7.10 s, p. ej. con él, aprox. lo previsto."]),
    ("На рис. 30 почти 39,5 % случаев, т. е. больше. «Где же сеть?» — спрашивает он. По данным Zemk и др., 13 при 2 г. и выше.", ["На рис. 30 почти 39,5 % случаев, т. е. больше.", "«Где же сеть?» — спрашивает он.", "По данным Zemk и др., 13 при 2 г. и выше."]),
    ("审稿人问：“梯度在哪里？为何没有边界？”随后又看了信号。“密度描述了流量。”误差为48.25%。这正是核函数!因此如此。", ["审稿人问：“梯度在哪里？为何没有边界？”随后又看了信号。", "“密度描述了流量。”", "误差为48.25%。", "这正是核函数!", "因此如此。"]),
    ("査読者は「界面は何か。根拠は？」と尋ね、見直した。なぜか?", ["査読者は「界面は何か。根拠は？」と尋ね、見直した。", "なぜか?"]),
    ("त्रुटि को समझाता है। डॉ. Zemk के अनुसार 39.47 गुना है। क्या?", ["त्रुटि को समझाता है।", "डॉ. Zemk के अनुसार 39.47 गुना है।", "क्या?"]),
    ("لماذا يضخم النموذج؟ في الشكل 17 نحو 44.48 من النموذج.", ["لماذا يضخم النموذج؟", "في الشكل 17 نحو 44.48 من النموذج."]),
    ("ทำไมตัวอย่าง แบบจำลองประมาณ 4.70 เท่า", ["ทำไมตัวอย่าง", "แบบจำลองประมาณ 4.70 เท่า"]),
    ("% note. one\n\\documentclass{a}\n\\def\\x{1. B}\n\\begin{document}\n\\title{T. U}\n\\section{H. I}\\label{s}\nFirst line\nends here.\n% between. it\nSecond\n% inside\nends. \n\nNo end\n\n\\begin{itemize}\n\\item Alpha beta\n\\item Gamma.\n\\end{itemize}\n\\begin{equation}\n x = 1 .\n\\end{equation}\n\\input{a.b}\nLast.\n\\end{document}\nafter. all", ["First line\nends here.", "Second\n% inside\nends.", "No end", "Alpha beta", "Gamma.", "Last."]),
    ("A.\r\n\r\nB b\r\n\r\n\\begin{verbatim}\r\nx. y", ["A.", "B b"]),
    ("\U0001f52c Odd  one. \U0001d53c two.", ["\U0001f52c Odd  one.", "\U0001d53c two."]),
    ("We met (one (a) two (b) three (c) four (d) five. Six) and left. Ok.", ["We met (one (a) two (b) three (c) four (d) five. Six) and left.", "Ok."]),
    ("We met (one. Two (a (b) c) f) and left. Ok.", ["We met (one. Two (a (b) c) f) and left.", "Ok."]),
    ("It holds\\footnote{" + " ".join(f"\\emph{{x{i}}}." for i in range(12)) + " Still inside.} which goes on. Ok.", ["It holds\\footnote{" + " ".join(f"\\emph{{x{i}}}." for i in range(12)) + " Still inside.} which goes on.", "Ok."]),
    ("He asked “Is it?” Yes. It is.", ["He asked “Is it?”", "Yes.", "It is."]),
    ("He asked “Is it?”" + " " * 45 + "Yes. It is.", ["He asked “Is it?”", "Yes.", "It is."]),
    ("Go " + "(" * 100 + "a. B" + ")" * 100 + " on. " + "(" * 3000 + "x. y", ["Go " + "(" * 100 + "a. B" + ")" * 100 + " on.", "(" * 3000 + "x.", "y"]),
    ("Rev. Smith and Col. Mustard met Sgt. Pepper. Ok.", ["Rev. Smith and Col. Mustard met Sgt. Pepper.", "Ok."]),
    ("", []),
    (None, []),
    ("...", []),
]


@pytest.fixture(scope="module")
def units(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)]
    got = sentences.sentences(spark.createDataFrame(rows, "doc_id bigint, text string, key string")).collect()
    out = {i: [] for i in range(len(CASES))}
    for r in sorted(got):
        out[r.doc_id].append(CASES[r.doc_id][0][r.start_char : r.end_char])
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_units(units, i):
    assert units[i] == CASES[i][1]


def test_long_text_and_repeats(spark):
    text = "This is one of many. " * 5000
    rows = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    got = sentences.sentences(rows).collect()
    assert len(got) == 10000
    assert all(text[r.start_char : r.end_char] == "This is one of many." for r in got)
    assert sentences.sentences(rows.limit(0)).count() == 0


def test_deep_and_wide_brackets(spark):
    wide = "It (" + "(a. b) " * 20000 + ") goes on. Next."
    deep = "It " + "(" * 255 + "a. b" + ")" * 255 + " goes on. Next."
    rows = spark.createDataFrame([(1, wide), (2, deep)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in sentences.sentences(rows).collect()) == [(i, a, b) for i, t in ((1, wide), (2, deep)) for a, b in ((0, len(t) - 6), (len(t) - 5, len(t)))]


def test_abbreviations_are_a_parameter(spark):
    rows = spark.createDataFrame([(1, "See Xyz. Abc there.")], "doc_id bigint, text string")
    assert sentences.sentences(rows).count() == 2
    assert sentences.sentences(rows, abbreviations={"always": "Xyz"}).count() == 1

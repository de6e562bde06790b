"""Sentence boundaries across languages and scripts, inside typesetting markup, in SQL expressions alone.

Positions survive every step, so that nothing has to be put back but the offsets. What is not running text becomes its length between two break
placeholders, a comment as many neutral ones as it has code points, and a terminator that ends nothing (in numbers, abbreviations, initials, formulas, quotations and brackets inside a sentence) one of a third kind. Separators are then set behind the
terminators that are left, by script, and the text is split there; running sums of the lengths of the pieces, taken in blocks so that a long
text costs no square of its length, give the offsets.

Defined results: null and empty texts, and texts without running text, give no units; a unit has a letter, a digit or a formula; an unclosed
environment reaches to the end of the text; equal rows each give their units. Brackets and braces may hold any number of pairs and nest up to 255 deep,
the most that the typesetter itself takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Placeholders from the private-use area; a text's own characters of these numbers are first replaced by a letter.
BREAK, COMMENT, QUIET, CUT = "\uf8f0", "\uf8f1", "\uf8f2", "\uf8f3"
MARKS = ".!?…。！？｡．।॥؟۔։።"
CLOSERS = "\"'”’»›」』）)\\]}〉》】"

ENVIRONMENTS = "equation|align|alignat|displaymath|eqnarray|gather|multline|math|verbatim|lstlisting|thebibliography"
#: Lines of these commands are no running text.
LINES = "documentclass|usepackage|newcommand|renewcommand|providecommand|def|let|DeclareMathOperator|title|author|date|maketitle|part|chapter|section|subsection|subsubsection|paragraph|input|include|includegraphics|bibliography|bibliographystyle|begin|end|label|tableofcontents"
_LINE = rf"[ \t]*\\(?:{LINES})\b"
LEXER = "|".join(
    [
        r"(?s:\A.*?\\begin\{document\}[^\n]*)",
        rf"\\begin\{{({ENVIRONMENTS})(\*?)\}}(?s:.*?)(?:\\end\{{\1\2\}}|\z)",
        r"\\end\{document\}(?s:.*)",
        r"\\\[(?s:.*?)\\\]",
        r"\$\$(?s:.*?)\$\$",
        r"(?<=\n|\A)[ \t]*%[^\n]*",
        rf"(?md:^{_LINE}[^\n]*)",
        r"\\item\b(?:[ \t]*\[[^\]\n]*\])?",
        r"\\[^\na-zA-Z]",
        r"\n[ \t\r]*\n",
        r"[^\\\n$%][^\\\n$]*+(?:\n(?![ \t\r]*\n))?",
        r"(?s:.)",
    ]
)
BROKEN = rf"^(?:\\(?:begin|end)\{{|\\\[(?s:.+)\\\]|\$\$|\\item\b|{_LINE})"

#: Abbreviations after which a sentence goes on, titles and ranks that stand before a name, those that only stand before a number, and those that may also
#: end a sentence; defaults of a parameter.
ALWAYS = "Dr|Dra|Prof|Mr|Mrs|Ms|Mme|Mlle|Sr|Sra|St|cf|Cf|vs|approx|aprox|Aprox|Ca|ca|bzw|vgl|Vgl|sog|resp|i\\.e|e\\.g|p\\. ej|ej|z\\. B|z|d\\. h|d|h|u\\. a|т\\. е|т|см|См|напр|c\\.-à-d|डॉ|श्री|pp|Lt|Gen"
TITLES = "Rev|Col|Sgt|Capt|Cpl|Maj|Cmdr|Adm|Gov|Sen|Pres|Hon|Messrs|Mt|Ft|Ing|Dipl|Hr|Hrn|Mag|Mgr|Lic|Arq|акад|проф|тов|им"
NUMBERED = "No|no|Nos|Nr|nr|Vol|vol|Fig|Figs|fig|figs|Eq|Eqs|eq|eqs|Éq|éq|Sec|Secs|sec|App|Abb|Tab|Kap|Bd|S|p|Ch|ch|Thm|Lem|рис|Рис|табл|гл|стр|núm|art|Art|cap"
ENDING = "etc|usw|ff|др|г|гг|д|п|al|a\\.m|p\\.m|Inc|Ltd|Jr|ebd"
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_W = r"(?<![\p{L}\p{N}\p{M}])"
ABBREVIATIONS = {"always": ALWAYS, "titles": TITLES, "numbered": NUMBERED, "ending": ENDING, "months": MONTHS}


def _silent(known: dict[str, str]) -> str:
    """Full stops that end nothing."""
    return (
        r"\.(?:(?<=\d\.)(?=\d)"
        rf"|(?<={_W}(?:{known['always']})\.)"
        rf"|(?<={_W}p\.)(?=\s*ej\.)"
        rf"|(?<={_W}(?:{known['titles']})\.)(?=[\s~]+\p{{Lu}})"
        rf"|(?<={_W}(?:{known['numbered']})\.)(?=[\s~]*[\d(\$\\])"
        rf"|(?<={_W}(?:{known['ending']})\.)(?=\s*[^\s\p{{Lu}}“«„‘(\\$])"
        rf"|(?<=\p{{Lu}}\.\p{{Lu}}\.)(?=\s*\S)"
        rf"|(?<=(?<![\p{{L}}\p{{N}}\p{{M}}°])(?<!\d[~ ])\p{{Lu}}\.)(?=[\s~]+\p{{Lu}})"
        rf"|(?<={_W}\d{{1,2}}\.)(?=\s+(?:{known['months']})\b))"
    )


DEEPEST = 255


def _nested(opening: str, closing: str) -> str:
    """A bracket with whatever balanced pairs it holds. Possessive throughout, so that no length costs more than one reading or any of the stack."""
    own = rf"[^{opening}{closing}{BREAK}]*+"
    out = rf"{opening}{own}{closing}"
    for _ in range(DEEPEST - 1):
        out = rf"{opening}{own}(?:{out}{own})*+{closing}"
    return out


_IN = f"[^%s{BREAK}]*+"
GROUPS = "|".join(
    [
        rf"\$[^${BREAK}]*+\$",
        rf"\\\([^{BREAK}]*?\\\)",
        rf"``[^{BREAK}]*?''",
        *(f"{a}{_IN % (a + b)}{b}" for a, b in ("“”", "«»", "‹›", "「」", "『』", "（）", "《》")),
        rf"„[^„“”{BREAK}]*+[“”]",
        _nested(r"\(", r"\)"),
        r"(?:\\[a-zA-Z]+)?" + _nested(r"\{", r"\}"),
        # what opens no group; the first class, which holds all blanks, is tested for every character, so it has few members and leaves some harmless ones to the second
        r"[^$\\`({\u00ab\u2010-\u203f\u3000-\u300f\uff00-\uff0f]++",
        r"[\u2010-\u201b\u201d\u201f-\u2038\u203a-\u203f\u3000-\u3009\u300b\u300d\u300f\uff00-\uff07\uff09-\uff0f]++",
        r"(?s:.)",
    ]
)
OPENERS = list("$\\`“«‹「『（《„({")
_BLANK = r"[\s\u00a0\u202f\u3000]"
_ENDS = rf"[{MARKS}](?:{_BLANK}?[“{CLOSERS}])+$"
_OPEN = r"[“«„‘‹「『（《(¿¡`\[{]*"


def _lexed(text: Column) -> Column:
    """Running text with all else replaced."""
    used = text.contains(BREAK) | text.contains(COMMENT) | text.contains(QUIET) | text.contains(CUT)
    own = F.when(used, F.translate(text, BREAK + COMMENT + QUIET + CUT, "xxxx")).otherwise(text)
    parts = F.regexp_extract_all(own, F.lit(LEXER), F.lit(0))

    def mask(s: Column, i: Column) -> Column:
        preamble = (i == 0) & s.contains("\\begin{document}")
        plain = ~F.substring(s, 1, 1).isin("%", "\\", "$", " ", "\t", "\n")
        return (
            F.when(plain & ~preamble, s)
            .when(preamble | s.rlike(BROKEN) | (s.startswith("\n") & (s != "\n")), F.concat(F.lit(BREAK), F.length(s).cast("string"), F.lit(BREAK)))
            .when(s.rlike(r"^[ \t]*%."), F.regexp_replace(s, r"(?s).", COMMENT))
            .otherwise(s)
        )

    return F.array_join(F.transform(parts, mask), "")


def _grouped(parts: Column) -> Column:
    """Terminators inside formulas, quotations and brackets made quiet, but for the last of a group with which its sentence ends."""
    quiet = QUIET * len(MARKS)

    def mask(s: Column, i: Column) -> Column:
        after = F.coalesce(F.get(parts, i + 1), F.lit(""))
        two = F.coalesce(F.get(parts, i + 2), F.lit(""))
        three = F.coalesce(F.get(parts, i + 3), F.lit(""))
        ahead = F.concat(after, two, three)  # a run of blanks is one part, so what follows it is in sight
        last = F.coalesce(F.get(parts, i - 1), F.lit(BREAK))
        behind = F.when(last.rlike(rf"^{_BLANK}*$"), F.concat(F.coalesce(F.get(parts, i - 2), F.lit(BREAK)), last)).otherwise(last)
        starts = behind.rlike(rf"(?:^|[{BREAK}{COMMENT}{MARKS}][{CLOSERS}]*){_BLANK}*$")
        ends = s.rlike(_ENDS) & ~s.rlike(r"^(?:\$|\\\()") & (
            ahead.rlike(rf"^{_BLANK}+{_OPEN}\p{{Lu}}")
            # a question or exclamation may be followed by who said it, a full stop is not
            | (starts & ~ahead.rlike(rf"^{_BLANK}*(?:[,;:，、；：—–-]|[{MARKS}])") & (~ahead.rlike(rf"^{_BLANK}*\p{{Ll}}") | s.rlike(rf"[.。．।۔።]{_BLANK}?[“{CLOSERS}]+$")))
        )
        head = F.regexp_extract(s, rf"^((?s:.*?))([{MARKS}]+(?:{_BLANK}?[“{CLOSERS}])+)$", 1)
        tail = F.regexp_extract(s, rf"^((?s:.*?))([{MARKS}]+(?:{_BLANK}?[“{CLOSERS}])+)$", 2)
        return (
            F.when(~F.substring(s, 1, 1).isin(*OPENERS) | (F.length(s) < 2) | ~s.rlike(f"[{MARKS}]"), s)
            .when(ends, F.concat(F.translate(head, MARKS, quiet), tail))
            .otherwise(F.translate(s, MARKS, quiet))
        )

    return F.array_join(F.transform(parts, mask), "")


_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_THAI = "\u0e01-\u0e3a\u0e40-\u0e4e"
_TAIL = rf"(?:{_BLANK}?[»›]|[{CLOSERS}]|“(?=[\s{BREAK}]|$))*"
SET = (
    rf"(?![a-zA-Z0-9 ,\n])((?:[。！？｡．।॥؟۔։።][{MARKS}]*+{_TAIL})(?!{_BLANK}*[,;:，、；：])"
    rf"|(?:[.!?…][{MARKS}]*+{_TAIL})(?=[\s{BREAK}{COMMENT}{_UNSPACED}“「『（《]|$)"
    rf"|[{_THAI}](?=\s+[{_THAI}])|{BREAK}[0-9]++{BREAK})"
)
BLANKS = " \t\n\x0b\f\r\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff" + COMMENT
BLOCK = 256


def _sizes(pieces: Column) -> Column:
    """Code points each piece stands for."""
    gap = lambda p: F.substring_index(F.substring_index(p, BREAK, -2), BREAK, 1).cast("int")
    return F.transform(pieces, lambda p: F.when(p.endswith(BREAK), F.length(F.substring_index(p, BREAK, 1)) + gap(p)).otherwise(F.length(p)))


def _sum(numbers: Column, first: Column | int, n: Column | int) -> Column:
    return F.aggregate(F.slice(numbers, first, n), F.lit(0), lambda a, x: a + x)


def _firsts(sizes: Column) -> Column:
    """Where each block of pieces starts."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    totals = F.transform(blocks, lambda b: _sum(sizes, b * BLOCK + 1, BLOCK))
    return F.transform(blocks, lambda b: _sum(totals, 1, b))


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", abbreviations: dict[str, str] | None = None) -> DataFrame:
    """(key, start_char, end_char) of every sentence unit, in code points from 0, end exclusive.

    abbreviations: alternatives, as patterns, in place of those of ABBREVIATIONS under the same name.
    """
    step = documents.where(F.length(text) > 0).select(F.col(key).alias("key"), _lexed(F.col(text)).alias("t"))
    step = step.withColumn("t", F.regexp_replace("t", _silent(ABBREVIATIONS | (abbreviations or {})), QUIET))
    step = step.select("key", F.regexp_extract_all("t", F.lit(GROUPS), F.lit(0)).alias("parts"))
    step = step.select("key", _grouped(F.col("parts")).alias("t"))
    step = step.select("key", F.split(F.regexp_replace("t", SET, "$1" + CUT), CUT).alias("pieces"))
    step = step.select("key", "pieces", _sizes(F.col("pieces")).alias("sizes"))
    step = step.select("key", "pieces", "sizes", _firsts(F.col("sizes")).alias("firsts"))
    step = step.select("key", "sizes", "firsts", F.posexplode_outer("pieces").alias("i", "p"))
    p = F.substring_index("p", BREAK, 1)
    block = F.expr(f"i div {BLOCK}").cast("int")
    step = step.where(p.rlike(r"[\p{L}\p{N}$]")).select("key", p.alias("p"), (F.get("firsts", block) + _sum(F.col("sizes"), block * BLOCK + 1, F.col("i") % BLOCK)).alias("at"))
    left, right = F.ltrim("p", F.lit(BLANKS)), F.rtrim("p", F.lit(BLANKS))
    step = step.select("key", (F.col("at") + F.length("p") - F.length(left)).alias("start_char"), (F.col("at") + F.length(right)).alias("end_char"))
    return step.withColumnRenamed("key", key)

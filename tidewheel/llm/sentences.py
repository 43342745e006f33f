"""Sentences of wiki texts in any language and script, as SQL expressions.

Per line of a text: marks that end no sentence (in decimals, addresses,
initials, abbreviations, ordinals, quotations, brackets, links, templates and
references) are replaced by a private-use placeholder, code point for code point;
script-specific patterns then set separators behind the terminators that are
left; the pieces' lengths give positions, and the sentence is read from the
original text, which restores what was masked.

Rules.  Full stops of scripts with marks of their own (such as the ideographic
one, danda, the Arabic question mark, the Armenian full stop) always end a
sentence.  ``.``, ``!``, ``?`` and dots of omission end one at the end of the line, before
a blank and a capital, digit, opening mark or letter of a script without case
(also a small letter directly before a capital, as in brand names), and directly
before a capital followed by a small letter.  The Greek question mark is a
semicolon after a Greek letter.  In Thai a blank between two Thai letters ends a
sentence.  Closing quotes, brackets and references after the mark belong to the
sentence.  A quotation, title or bracket is kept whole; the mark before its
closing sign ends the sentence only if what follows starts one, and in scripts
without case only if the quotation did not open the sentence.

A pair of brackets or quotation marks is looked for within one line.

Defined cases: null and empty texts and lines without letters of their own give
no rows for their blank lines; repeated rows give each sentence once; very long
lines are handled in time linear in their length, but for the table of positions,
which is built in blocks; other columns are not read.

Not decided: in a line all in capitals nothing tells a name that ends in ! or ?
from the end of a sentence, so such a name ends one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M, _SEP = "\\ue000", "\\ue001"
# Members of character classes.  Rare characters are in a class of their own behind a range or two, so that those of the
# common scripts fail after a few tests.
_BLANK = "\\s\\u00a0[\\u1680-\\u3000&&[\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]"
_BLANK_CHARS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Unicode's Sentence_Terminal characters of the basic plane but for . ! ?, and the Tibetan shads; a class for each
# stretch of scripts behind its range.
_STRONG = (
    "[\\u0589-\\uffff&&["
    "[\\u0589-\\u06d4&&[\\u0589\\u061d-\\u061f\\u06d4]]"
    "[\\u0700-\\u083e&&[\\u0700-\\u0702\\u07f9\\u0837\\u0839\\u083d\\u083e]]"
    "[\\u0964-\\u0965]"
    "[\\u0f0d-\\u1c7f&&[\\u0f0d\\u0f0e\\u104a\\u104b\\u1362\\u1367\\u1368\\u166e\\u1735\\u1736\\u17d4\\u17d5\\u1803\\u1809\\u1944\\u1945\\u1aa8-\\u1aab\\u1b5a\\u1b5b\\u1b5e\\u1b5f\\u1b7d-\\u1b7f\\u1c3b\\u1c3c\\u1c7e\\u1c7f]]"
    "[\\u203c-\\u2e54&&[\\u203c\\u203d\\u2047-\\u2049\\u2e2e\\u2e3c\\u2e53\\u2e54]]"
    "\\u3002"
    "[\\ua4ff-\\uabeb&&[\\ua4ff\\ua60e\\ua60f\\ua6f3\\ua6f7\\ua876\\ua877\\ua8ce\\ua8cf\\ua92f\\ua9c8\\ua9c9\\uaa5d-\\uaa5f\\uaaf0\\uaaf1\\uabeb]]"
    "[\\ufe52-\\uff61&&[\\ufe52\\ufe56\\ufe57\\uff01\\uff0e\\uff1f\\uff61]]"
    "]]"
)
_ANY = ".!?…;\\u037e" + _STRONG  # marks that can be masked
_CLOSE = "”’»)\\]」』》〉）】\"›"
_OPEN = "“„«‘¿¡(\\[「『《〈（【\"‹\\u2039"
_CASELESS = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}\\p{IsDevanagari}\\p{IsBengali}\\p{IsArabic}\\p{IsHebrew}\\p{IsTamil}\\p{IsTelugu}"
_THAI = "\\u0e01-\\u0e3a\\u0e40-\\u0e4e"

# Abbreviations whose full stop never ends a sentence.
ABBREVIATIONS = {
    "en": "Mr Mrs Ms Messrs Dr Prof St Sts Mt Ft Lt Col Gen Capt Cmdr Maj Sgt Cpl Rev Hon Gov Sen Rep Pres Adm No Nos vol vols fig figs p pp ed eds cf vs al approx ca i.e e.g viz ch sec ref resp est",
    "de": "Nr Bd Bde Abb Hrsg hrsg Hl St Str bzw vgl lt ca geb gest Jh sog evtl ggf inkl exkl zzgl Tel Art Abs Kap Anm Dipl Ing Frl Hr Fr",
    "fr": "M MM Mme Mmes Mlle Mgr Me env chap art éd vol réf av apr Av Bd Cie",
    "es": "Sr Sra Srta Sres Dr Dra Av Avda núm núms pág págs vol cap art Ud Uds Vd Lic Ing Gral Cnel Arq Prof",
    "ru": "Проф проф акад им ул Ул пр просп пер пл стр гл рис табл тыс млн млрд св см ср напр тов гр обл г-н г-жа",
    "el": "κ κκ κα αρ σελ βλ δηλ π.χ τ.χλμ χλμ δρ Δρ Αγ αι",
    "hi": "डॉ श्री श्रीमती पं प्रो कि.मी कि सं",
    "ar": "د أ م ص",
    "hy": "թ հ էջ պրոֆ",
}
# More titles, months and short forms, by language.
MORE_ABBREVIATIONS = {
    "en": "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Tues Wed Thu Thurs Fri Sat Univ Dept Assn Inst Intl Natl Ave Blvd Hwy Bldg Supt Atty Bros Brig Insp Cllr approx misc est",
    "it": "sig Sig sigg Sigg sigra dott Dott dottssa avv Avv geom Geom rag cav Cav egr Egr spett Spett pagg",
    "pt": "Exmo Exma Exmos Exmas Ilmo Ilma Profa Sras Srs Eng Enga",
    "nl": "Dhr dhr Mevr mevr Mw mw Drs drs blz Blz bijv",
    "pl": "św inż mgr płk ppłk hab tzw tzn",
    "sv": "dvs resp fr.o.m t.o.m bl.a t.ex s.k",
    "tr": "Doç Sn Cad Sok Mah",
}
# Short forms behind a name that may also end a sentence, which they do before one of the words below.
TRAILING_ABBREVIATIONS = "Jr Sr Corp Esq"
SENTENCE_STARTERS = "A An And As At Before But By During For From He Her His However If In It Its Later Many Most No On Since She Some That The Their Then There These They This Those Under Until Was We What When Where While Who Why With You"
# In lines all in capitals also these.
CAPITAL_ABBREVIATIONS = "ETC INC CO YRS P.M A.M U.N.E HAB USW FF EJ CF AL VS ED DRX ЧЕЛ РУБ Т.Е ΔΡΧ"
# What follows a German ordinal of one or two digits.
AFTER_ORDINALS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Jahrhunderts|Jh|Jahrtausend|Klasse|Kapitel|Auflage|Platz|Band"

_WORDS = sorted({w for table in (ABBREVIATIONS, MORE_ABBREVIATIONS) for ws in table.values() for w in ws.split()}, key=lambda w: (-len(w), w))


def _alternatives(words) -> str:
    return "|".join(w.replace(".", "\\.") for w in words)


def _q(s: str) -> str:
    """A string literal for SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Segments that stay whole: links, templates and references; then brackets and quotations.
_INERT = (
    "\\{\\{\\{[^{}\\n]*+\\}\\}\\}|\\{\\{[^{}\\n]*+(?:\\{\\{\\{?[^{}\\n]*+\\}\\}\\}?[^{}\\n]*+)*+\\}\\}"
    "|\\[\\[[^\\[\\]\\n]*+(?:\\[\\[[^\\[\\]\\n]*+\\]\\][^\\[\\]\\n]*+)*+\\]\\]"
    "|(?i:<ref[^<>]*+/>|<ref[^<>/]*+>[^<]*+(?:<(?!/ref>)[^<]*+)*+</ref>|<!--[^<>]*+-->)"
)
_PAIRS = (
    "\\([^()\\n]*+(?:\\([^()\\n]*+\\)[^()\\n]*+)*+\\)|（[^（）\\n]*+）|【[^【】\\n]*+】"
    "|„[^„“”\\n]*+[“”]|“[^“”\\n]*+”|‘[^‘’\\n]*+(?:’(?=\\p{L})[^‘’\\n]*+)*+’|«[^«»\\n]*+»|‹[^‹›\\n]*+›|「[^「」\\n]*+」|『[^『』\\n]*+』|《[^《》\\n]*+》|〈[^〈〉\\n]*+〉|\"[^\"\\n]*+\""
)
_OPENERS = "{\\[<(（【„“‘«‹「『《〈\""
_OPENERS_G = f"\"(<\\[{{\\u00ab\\u2018-\\uffff&&[{_OPENERS}]"
_SEGMENT = f"[^{_OPENERS_G}]++|{_INERT}|{_PAIRS}|(?s:.)"


def _segments(line: str) -> str:
    """The line with marks inside whole segments masked."""
    blanks = f"[{_BLANK}]"
    ended = f"(?:\\A|[{_ANY}][{_CLOSE}]*+){blanks}*+\\z"
    caseless = f"\\A{blanks}*+[{_CASELESS}]"
    prev = "CASE WHEN i = 0 THEN '' ELSE segs[i - 1] END"
    after = "CASE WHEN i + 1 < size(segs) THEN segs[i + 1] ELSE '' END"
    opens = f"left(s, 1) NOT IN ('(', '（', '【') AND ({after}) RLIKE {_q(caseless)} AND (({prev}) LIKE '<ref%' OR ({prev}) RLIKE {_q(ended)})"
    all_masked = f"regexp_replace(s, {_q(f'[{_ANY}{_BLANK}]')}, '{_M}')"
    # all but the marks right before the closing sign
    inner_masked = f"regexp_replace(s, {_q(f'[{_ANY}{_BLANK}](?![{_ANY}{_BLANK}]*+(?s:.)\\z)')}, '{_M}')"
    one = (
        f"CASE WHEN length(s) < 2 OR left(s, 1) NOT IN ('{{', '[', '<', '(', '（', '【', '„', '“', '‘', '«', '‹', '「', '『', '《', '〈', '\"') THEN s "
        f"WHEN left(s, 1) IN ('{{', '[', '<') OR ({opens}) THEN {all_masked} "
        f"WHEN left(s, 1) = '„' THEN concat(left({inner_masked}, length(s) - 1), '”') ELSE {inner_masked} END"
    )
    cut = f"regexp_extract_all({line}, {_q('(' + _SEGMENT + ')')}, 1)"
    whole = f"array_join(transform(array({cut}), segs -> array_join(transform(segs, (s, i) -> {one}), '')), '')"
    address = f"\\.(?=[^{_BLANK}])(?<=(?i:://|www)[^{_BLANK}]{{1,200}})"
    has_address = " OR ".join(f"contains({line}, '{a}')" for a in ("://", "www.", "WWW.", "Www."))
    return f"CASE WHEN {has_address} THEN regexp_replace({whole}, {_q(address)}, '{_M}') ELSE {whole} END"


def _mask_words(m: str) -> str:
    """Full stops of decimals, initials, abbreviations and ordinals masked."""
    before = "(?<![\\p{L}\\p{M}\\p{N}])"
    # one letter: an initial or a short form, but not the last of several (B.C.) nor the Russian year;
    # it may stand right behind the end of a sentence, where the blank was forgotten
    initial = "(?<=(?<![\\p{L}\\p{M}\\p{N}.])\\p{L}\\.|(?<=[\\p{L}\\p{Nd}][\\p{Ll}\\p{Nd})”’»][.!?…])\\p{Lu}\\.)(?<!(?<![\\p{L}])г\\.)(?<!т\\.[ \\u00a0]?[дп]\\.)"
    word = f"(?<!\\p{{Ll}}{{8}}\\.)(?<={before}(?:{_alternatives(_WORDS)})\\.)"
    trailing = f"(?<={before}(?:{_alternatives(TRAILING_ABBREVIATIONS.split())})\\.)(?=[{_BLANK}]++\\p{{Lu}})(?![{_BLANK}]++(?:{_alternatives(SENTENCE_STARTERS.split())})\\b)"
    ordinal = f"(?=[ \\u00a0](?:{AFTER_ORDINALS})\\b)(?<=(?<![\\p{{N}}.,])\\p{{Nd}}{{1,2}}\\.)"
    # Only a full stop before a blank and no small letter, or before a capital, could end a sentence at all.
    could = f"(?=[{_BLANK}]++[^\\p{{Ll}}]|[{_BLANK}]++\\p{{Ll}}\\p{{Lu}}|[\\p{{Lu}}\\p{{Lo}}{_M}])"
    reasons = ["(?=[0-9\\p{Nd}])", f"{could}(?:(?<!\\p{{Nd}}\\.)(?:{initial}|{word}|{trailing})|{ordinal})"]
    words = sorted({w.upper() for w in _WORDS} | set(CAPITAL_ABBREVIATIONS.split()), key=lambda w: (-len(w), w))
    capitals = f"regexp_replace({m}, {_q(f'\\.(?<={before}(?:{_alternatives(words)})\\.)')}, '{_M}')"
    line = f"CASE WHEN {m} RLIKE {_q('\\A[^\\p{Ll}]*+\\z')} AND {m} RLIKE {_q('\\p{Lu}[^\\p{Lu}]*+\\p{Lu}')} THEN {capitals} ELSE {m} END"
    pattern = "\\.(?:" + "|".join(reasons) + ")"
    return f"regexp_replace({line}, {_q(pattern)}, '{_M}')"


def _separated(m: str) -> str:
    """Separators behind the ends of sentences."""
    closers = f"(?:[{_CLOSE}]|[{_BLANK}]++[»›])*+(?:(?i:<ref)[^<>]*+>(?:[^<]*+(?i:</ref>))?+)*+"
    start = f"(?:[{_OPEN}'*\\ue000]*+(?:[\\p{{Lu}}\\p{{Lt}}\\p{{Nd}}\\p{{Lo}}\\p{{So}}]|\\p{{Ll}}\\p{{Lu}})|[{_OPEN}])"
    glued = (
        f"[{_OPEN}]*+\\p{{Lu}}\\p{{Ll}}|(?<=[\\p{{Ll}}\\p{{Nd}})”’»][.!?…])\\p{{Lu}}[{_BLANK}{_M}]|[¿¡]|(?<=[\\p{{Ll}}\\p{{Nd}}][.!?…])[“«„]"
        f"|(?<=[{_CASELESS}\\p{{M}}][.!?…])[{_CASELESS}]|(?<=[{_CASELESS}\\p{{M}}][!?…])[\\p{{Nd}}“«]"
    )
    follows = f"(?=[{_BLANK}]++{start}|[{_BLANK}]*+\\z|{glued})"
    # A mark first, so that a position without one costs few tests.
    pattern = (
        f"([.!?][.!?…]*+(?:{closers}{follows}|{_STRONG}[{_STRONG}.!?…]*+{closers})"
        f"|[;…\\u037e{_STRONG}](?:(?<={_STRONG})[{_STRONG}.!?…]*+{closers}"
        f"|(?<=…)(?:(?=…)…[{_STRONG}…]*+{closers}(?=[^{_BLANK}，、；：,;:—…]|\\z)|(?<![{_BLANK}]…)[.!?…]*+{closers}{follows})"
        f"|(?<=\\p{{IsGreek}}[;\\u037e]){closers}{follows}))"
    )
    ends = f"regexp_replace({m}, {_q(pattern)}, {_q('$1' + chr(0xE001))})"
    thai = f"([{_BLANK}]++)(?<=[{_THAI}][{_BLANK}]{{1,20}})(?=[{_THAI}])"
    return f"CASE WHEN octet_length({m}) >= length({m}) + 4 AND {m} RLIKE {_q(f'[{_THAI}]')} THEN regexp_replace({ends}, {_q(thai)}, {_q('$1' + chr(0xE001))}) ELSE {ends} END"


# Lines that hold no sentences.
_SKIP = (
    f"\\A[{_BLANK}]*+\\z|\\A(?:[={{|}}!<]|----)|\\A#\\p{{L}}[\\p{{L}}\\p{{M}}]*+[{_BLANK}]*+:?[{_BLANK}]*+\\[\\[[^\\[\\]]*+\\]\\]"
    f"|\\A\\[\\[[^\\[\\]|]*?:[^\\[\\]]*+(?:\\[{{1,2}}[^\\[\\]]*+\\]{{1,2}}[^\\[\\]]*+)*+\\]\\][{_BLANK}]*+\\z"
)


_BLOCK = 256


def _starts(array: str, gap: int) -> str:
    """Where each string of an array starts, if ``gap`` characters lie between two.

    Arrays grow by copying, so long ones are built in blocks, which are then put together.
    """
    blocks = f"transform(sequence(0, greatest(size({array}) - 1, 0) div {_BLOCK}), b -> transform(slice({array}, b * {_BLOCK} + 1, {_BLOCK}), x -> length(x) + {gap}))"
    grow = "named_struct('at', {at}, 'all', CAST(array() AS array<int>)), (a, n) -> named_struct('at', a.at + {n}, 'all', array_append(a.all, a.at)), a -> a.all"
    first = f"aggregate(bs, {grow.format(at='0', n='aggregate(n, 0, (t, y) -> t + y)')})"
    inner = f"aggregate(own, {grow.format(at='start', n='n')})"
    short = f"aggregate({array}, {grow.format(at='0', n=f'length(n) + {gap}')})"
    return f"CASE WHEN size({array}) <= {_BLOCK} THEN {short} ELSE flatten(transform(array({blocks}), bs -> flatten(zip_with(bs, {first}, (own, start) -> {inner})))) END"


def sentence_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence, each once."""
    lines = (
        docs.select(F.col(doc_id).alias("doc_id"), F.split(F.col(text), "\n", -1).alias("ls"))
        .where("ls is not null")
        .selectExpr("doc_id", f"explode(filter(arrays_zip(ls, {_starts('ls', 1)}), x -> NOT x.ls RLIKE {_q(_SKIP)})) AS x")
        .selectExpr("doc_id", "x.`1` AS base", "x.ls AS line")
    )
    marker = f"regexp_extract(line, {_q(f'\\A([*#:]*+[{_BLANK}]*+)')}, 1)"
    body = (
        lines.selectExpr("doc_id", f"length({marker}) AS skip", "base", "line")
        .selectExpr("doc_id", "base + skip AS base", f"translate(substring(line, skip + 1), '{_SEP}', '{_M}') AS m")
    )
    pieces = (
        body.selectExpr("doc_id", "base", f"{_segments('m')} AS m")
        .selectExpr("doc_id", "base", f"{_mask_words('m')} AS m")
        .selectExpr("doc_id", "base", f"split({_separated('m')}, '{_SEP}') AS ps")
        .selectExpr("doc_id", "base", f"explode(arrays_zip(ps, {_starts('ps', 0)})) AS p")
        .selectExpr("doc_id", "base + p.`1` AS base", "p.ps AS piece")
    )
    lead = "length(piece) - length(ltrim(" + _q(_BLANK_CHARS) + ", piece))"
    trail = "length(piece) - length(rtrim(" + _q(_BLANK_CHARS) + ", piece))"
    spans = (
        pieces.selectExpr("doc_id", "base", "length(piece) AS n", f"{lead} AS lead", f"{trail} AS trail")
        .where("n > lead")
        .selectExpr("doc_id", "CAST(base + lead AS int) AS start_pos", "CAST(base + n - trail AS int) AS end_pos")
    )
    return spans.distinct()


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans with their text, read from the original."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).dropDuplicates(["doc_id"])
    return sentence_spans(docs, doc_id, text).join(own, "doc_id").select(
        "doc_id", "start_pos", "end_pos", F.substring("body", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")).alias("sentence")
    )

"""Transcript cleaning and normalisation as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace that Python's ``str.split`` and ``\s`` know, as a Java regex class body.
SPACES = r"\p{Z}\t-\r\x1c-\x1f\x85"
WS = f"[{SPACES}]"
# The same signs one by one.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Whitespace that is not one plain space between two words already.
UNEVEN_WS = f" {WS}+|[{SPACES}&&[^ ]]{WS}*"
NOT_WORD_OR_SPACE = rf"[^\p{{L}}\p{{N}}_{SPACES}]+"

# Buckwalter transliteration, each Latin sign and the Arabic sign it stands for.
BUCKWALTER = {
    "'": "ء", ">": "أ", "&": "ؤ", "<": "إ", "}": "ئ", "A": "ا", "b": "ب", "p": "ة", "t": "ت", "v": "ث",
    "j": "ج", "H": "ح", "x": "خ", "d": "د", "*": "ذ", "r": "ر", "z": "ز", "s": "س", "$": "ش", "S": "ص",
    "D": "ض", "T": "ط", "Z": "ظ", "E": "ع", "g": "غ", "_": "ـ", "f": "ف", "q": "ق", "k": "ك", "l": "ل",
    "m": "م", "n": "ن", "h": "ه", "w": "و", "Y": "ى", "y": "ي", "F": "ً", "N": "ٌ", "K": "ٍ", "a": "َ",
    "u": "ُ", "i": "ِ", "~": "ّ", "o": "ْ", "`": "ٰ", "{": "ٱ", "^": "ٓ", "#": "٪", "@": "ۚ", "[": "ۖ",
    ";": "ۗ", ",": "ۘ", ".": "۠", "!": "ۡ",
}

# Arabic marks that are dropped (first and last code points), letters that are folded,
# the block that is kept.
ARABIC_MARKS = ((0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED))
ARABIC_FOLDS = {"إ": "ا", "أ": "ا", "آ": "ا", "ى": "ي", "ة": "ه"}
ARABIC_BLOCK = r"\u0600-\u06ff"

# Spoken punctuation tags (with the space before them) and tags without speech.
PUNCTUATION_TAGS = {" <COMMA>": ",", " <PERIOD>": ".", " <QUESTIONMARK>": "?", " <EXCLAMATIONPOINT>": "!"}
SILENT_TAGS = ("<SIL>", "<MUSIC>", "<NOISE>", "<OTHER>")

# A bracket that holds nothing but a time stamp's signs.
TIME_TAG = rf"\[[\p{{Nd}}{SPACES}\-msh]+\]"

# Correction tag per language, and the words that mark a refusal.
CORRECTION_TAGS = {"ar": "مصحح"}
DEFAULT_CORRECTION_TAG = "corrected"
REFUSAL_WORDS = ("error", "sorry", "cannot")


def strip_ws(c: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """One space between words, none at the ends; case kept."""
    return F.trim(F.regexp_replace(c, UNEVEN_WS, " "))


def words(c: Column) -> Column:
    """Words of a text, split on runs of whitespace, without empty ones."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def buckwalter_to_arabic(c: Column) -> Column:
    """Latin transliteration to Arabic script; unknown characters stay."""
    return F.translate(c, "".join(BUCKWALTER), "".join(BUCKWALTER.values()))


def normalize_ar(c: Column) -> Column:
    """Arabic comparison form: no marks, folded letters, Arabic block only. Null gives ''.

    No letter of the block has case, so there is none to fold.
    """
    marks = "".join(chr(code) for first, last in ARABIC_MARKS for code in range(first, last + 1))
    # letters without a counterpart are dropped
    text = F.translate(F.coalesce(c, F.lit("")), "".join(ARABIC_FOLDS) + marks, "".join(ARABIC_FOLDS.values()))
    return squeeze(F.regexp_replace(text, f"[^{ARABIC_BLOCK}{SPACES}]+", ""))


def normalize_generic(c: Column) -> Column:
    """Lower case, letters, digits and ``_`` only, single spaces. Null gives ''."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return squeeze(F.regexp_replace(text, NOT_WORD_OR_SPACE, ""))


def normalize_for(c: Column, lang: Column | str) -> Column:
    """Normalise for comparison in the given language (a code or a column of codes)."""
    if isinstance(lang, str):
        return normalize_ar(c) if lang == "ar" else normalize_generic(c)
    return F.when(lang == "ar", normalize_ar(c)).otherwise(normalize_generic(c))


def normalize_ws(c: Column) -> Column:
    """Lower case and single spaces."""
    return squeeze(F.lower(c))


def normalize_extreme(c: Column) -> Column:
    """Lower case without punctuation, single spaces; null stays null."""
    return squeeze(F.regexp_replace(F.lower(c), NOT_WORD_OR_SPACE, ""))


def restore_sentence_case(c: Column) -> Column:
    """Turn punctuation tags into signs, drop silent tags, capitalise sentence starts only."""
    text = c
    for tag, sign in PUNCTUATION_TAGS.items():
        text = F.replace(text, F.lit(tag), F.lit(sign))
    for tag in SILENT_TAGS:
        text = F.replace(text, F.lit(tag), F.lit(""))

    def sentence(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s, r"^\P{L}*", 0))
        head = F.substring(s, F.lit(1), lead + 1)
        return F.concat(F.upper(head), F.lower(F.substring(s, lead + 2, F.length(s))))

    text = F.array_join(F.transform(F.split(text, r"(?<=[.!?])"), sentence), "")
    text = F.replace(text, F.lit(" i "), F.lit(" I "))
    return F.replace(text, F.lit(" i'"), F.lit(" I'"))


PROFILES = {
    "normalize_text": normalize_ws,
    "capitalize_remove_punctuation": restore_sentence_case,
    "extreme": normalize_extreme,
    "both": lambda c: normalize_ws(restore_sentence_case(c)),
}


def clean_profile(c: Column, profile: str) -> Column:
    """Apply a named cleaning profile."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; known: {', '.join(PROFILES)}")
    return PROFILES[profile](c)


def strip_time_tags(c: Column) -> Column:
    """Drop bracketed time stamps, then single spaces. Null gives ''."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), TIME_TAG, ""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tagged(resp: Column, tag: str, truncated: Column, compat: bool) -> Column:
    """Usable text of a stripped reply, else null."""
    opening, closing = f"<{tag}>", f"</{tag}>"
    closed = rf"(?s){opening}(.*?){closing}"
    after = F.substring(resp, F.instr(resp, opening) + len(opening), F.length(resp))
    low = F.lower(resp)
    usable = F.length(resp) > 10
    for word in REFUSAL_WORDS:
        usable = usable & ~F.contains(low, F.lit(word))
    found = (
        F.when(F.rlike(resp, F.lit(closed)), strip_ws(F.regexp_extract(resp, closed, 1)))
        .when(F.contains(resp, F.lit(opening)), F.when(~truncated, strip_ws(after)))
    )
    if not compat:
        # the prompt ends with the opening tag, so a well-formed reply has the closing one only
        before = F.substring_index(resp, closing, 1)
        found = found.when(F.contains(resp, F.lit(closing)), strip_ws(before))
    return found.when(usable, resp)


def extract_tagged(resp: Column, base: Column, lang: Column, truncated: Column, compat: bool = False) -> Column:
    """The corrected text in a model's reply, or ``base`` where the reply holds none.

    A text below 0.3 of the base's length counts as none. ``compat=True`` leaves a closing tag
    without its opening one in the text.
    """

    def by_language(reply: Column) -> Column:
        cond = None
        for code, tag in CORRECTION_TAGS.items():
            value = _tagged(reply, tag, truncated, compat)
            cond = F.when(lang == code, value) if cond is None else cond.when(lang == code, value)
        return cond.otherwise(_tagged(reply, DEFAULT_CORRECTION_TAG, truncated, compat))

    found = _once(strip_ws(resp), by_language)
    return _once(found, lambda text: F.when(F.length(text) >= F.length(base) * 0.3, text).otherwise(base))


def prompt(template: str, fields: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` places of a template; null fields become ''."""
    parts: list[Column] = []
    rest = template
    while rest:
        name, at = None, len(rest)
        for key in fields:
            hit = rest.find("{" + key + "}")
            if 0 <= hit < at:
                name, at = key, hit
        if at:
            parts.append(F.lit(rest[:at]))
        if name is None:
            break
        parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts) if parts else F.lit("")


def prompt_by_language(
    templates: Mapping[str, str], default: str, lang: Column, fields: Mapping[str, Column]
) -> Column:
    """Fill the template of the row's language, else the default one."""
    other = prompt(default, fields)
    cond = None
    for code, template in templates.items():
        value = prompt(template, fields)
        cond = F.when(lang == code, value) if cond is None else cond.when(lang == code, value)
    return other if cond is None else cond.otherwise(other)

"""Forms of texts that corpus jobs compare, as native expressions. Texts are in Unicode NFC, as the readers leave them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that give a label, and all characters that are taken off the edges of a token.
MARKS = {",": "COMMA", ".": "PERIOD", "?": "QUESTION", "!": "PERIOD", ";": "COMMA", ":": "COMMA"}
EDGES = ",.?!;:\"'()[]{}…"
_EDGE = "[" + "".join("\\" + c for c in EDGES) + "]"
_WORD = r"\p{L}\p{M}\p{N}_"
TOKENS = "struct<words:array<string>,punct:array<string>>"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def no_edges(text: Column) -> Column:
    """Without marks, quotes and brackets at its edges."""
    return F.regexp_replace(F.trim(text), f"^{_EDGE}+|{_EDGE}+$", "")


def without_marks(text: Column) -> Column:
    """Without punctuation, but for what stands inside numbers and addresses; case stays."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^{_WORD}\s/:.,+\-]", " "), "[,.;:!?]+", " "))


def folded(text: Column) -> Column:
    return F.lower(without_marks(text))


def _parts(text: Column, cut: str, first: str, change) -> Column:
    """The text with change() applied to the first letter of each part, where first matches what may stand before it."""

    def one(part: Column) -> Column:
        lead = F.regexp_extract(part, f"^({first})", 1)
        rest = F.substr(part, F.length(lead) + 1)
        return F.concat(lead, change(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2)))

    return F.array_join(F.transform(F.split(text, cut, -1), one), "")


def comparable(text: Column) -> Column:
    """without_marks() with the case of sentence beginnings taken away, as the renderer makes it."""
    return without_marks(_parts(F.coalesce(text, F.lit("")), r"(?<=[.!?])", r"\s*", F.lower))


def with_sentence_case(text: Column) -> Column:
    """The first letter of the text, and of what follows . ? or ! with a blank, in upper case."""
    return _parts(text, r"(?<=[.?!])(?=\s)", r"[^\p{L}]*", F.upper)


def aligned_target(text: Column) -> Column:
    """Semicolons as commas; positions with degrees of two digits (three for E and W), minutes of two and a decimal point."""
    minutes = r"°\d+(?:,\d+)?[′']"
    east = rf"(?={minutes}(?:\d{{2}}[″\"])?[EW])"
    out = F.replace(text, F.lit(";"), F.lit(","))
    for pattern, by in (
        (rf"(?<!\d)0+(?=\d+{minutes})", ""), (rf"(?<!\d)(\d){east}", "00$1"), (rf"(?<!\d)(\d\d){east}", "0$1"), (rf"(?<!\d)(\d)(?={minutes})", "0$1"),
        (r"(?<=\d°)0+(?=\d+(?:,\d+)?[′'])", ""), (r"(?<=\d°)(\d)(?=(?:,\d+)?[′'])", "0$1"), (r"(\d°\d{2,}),(\d+[′'])", "$1.$2"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return out


def tokens(text: Column, lower: bool = False) -> Column:
    """struct(words, punct): words without marks at their edges; the leftmost mark behind a word is its label, and a mark that
    stands alone labels the word before it."""
    names = F.create_map(*(F.lit(x) for k, v in MARKS.items() for x in (k, v)))
    mark = "[" + "".join("\\" + c for c in MARKS) + "]"

    def one(t: Column) -> Column:
        tail = F.regexp_extract(F.regexp_extract(t, f"({_EDGE}*)$", 1), f"({mark})", 1)
        word = no_edges(t)
        return F.struct((F.lower(word) if lower else word).alias("word"), F.when(tail == "", "O").otherwise(F.try_element_at(names, tail)).alias("label"))

    def step(acc: Column, t: Column) -> Column:
        n = F.size(acc["words"])
        moved = F.concat(F.slice(acc["punct"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(t["label"]))
        alone = F.struct(acc["words"].alias("words"), F.when((n > 0) & (t["label"] != "O"), moved).otherwise(acc["punct"]).alias("punct"))
        return F.when(t["word"] == "", alone).otherwise(F.struct(F.concat(acc["words"], F.array(t["word"])).alias("words"), F.concat(acc["punct"], F.array(t["label"])).alias("punct")))

    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    none = F.array().cast("array<string>")
    return F.aggregate(F.transform(raw, one), F.struct(none.alias("words"), none.alias("punct")), step)


def without_spurious_zero(text: Column) -> Column:
    """The filler that stands for an empty ten must not stand before a ten."""
    return F.regexp_replace(text, r"(?U)\b(?:linh|lẻ)\s+((?:một|hai|ba|bốn|năm|sáu|bảy|tám|chín)\s+(?:mươi|mười))\b", "$1")


def is_capitalized(word: Column) -> Column:
    c = F.substring(word, 1, 1)
    return F.coalesce(c.rlike(r"^\p{Lu}"), F.lit(False))


def without_quotes(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, "[\"“”]", " "))


def file_key(name: Column) -> Column:
    """Lower case ASCII letters and digits, without accents, for pairing names of files."""
    plain, accents = _plain_letters()
    return squeeze(F.regexp_replace(F.translate(F.lower(name), accents, plain), "[^a-z0-9]+", " "))


def reading(text: Column) -> Column:
    """A reading as it is compared: lower case, letters and blanks."""
    return squeeze(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), rf"[^{_WORD}\s]", " "))


#: Letters of Vietnamese besides the ASCII ones.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"


def _plain_letters() -> tuple[str, str]:
    from .keys import fold

    return "".join(map(fold, VIETNAMESE)), VIETNAMESE

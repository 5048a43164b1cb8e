"""Spoken to written form for 46 types. Each is a function of the words of a span that returns text or raises Miss."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from ipaddress import IPv6Address

from . import catalogues, keys
from . import lexicon as L
from .numbers import Miss, grouped, number, read_cardinal, read_digits, read_number, read_year, signed, small

Words = list[str]


def _table(forms: dict[str, list[str]]) -> list[tuple[Words, str]]:
    """(spoken words, symbol), longest first."""
    return sorted(((s.split(), symbol) for symbol, spoken in forms.items() for s in spoken), key=lambda x: -len(x[0]))


_LETTERS = _table(L.LETTERS | {"D": [*L.LETTERS["D"], L.D_OR_DD]})
_UNITS = _table(L.UNITS)
_CURRENCIES = _table(L.CURRENCIES)
_SYMBOLS = _table(L.ELECTRONIC_SYMBOLS)
_DASHES, _SLASHES = _table({"-": L.DASHES}), _table({"/": L.SLASHES})
_DIGIT_WORDS = {*L.DIGITS, "mười", "mươi"}


def _starts(words: Words, i: int, table: list[tuple[Words, str]]) -> tuple[str, int] | None:
    return next(((symbol, i + len(s)) for s, symbol in table if words[i : i + len(s)] == s), None)


def _ends(words: Words, table: list[tuple[Words, str]]) -> tuple[Words, str] | None:
    return next(((words[: -len(s)], symbol) for s, symbol in table if len(words) > len(s) and words[-len(s) :] == s), None)


def _run(words: Words, i: int, among: set[str]) -> int:
    while i < len(words) and words[i] in among:
        i += 1
    return i


def _cut(words: Words, marks: set[str]) -> tuple[Words, Words] | None:
    for i, w in enumerate(words):
        if w in marks:
            return words[:i], words[i + 1 :]
    return None


def spell(words: Words) -> str:
    """Letters by name, runs of digits, and ASCII words as they are, in capitals."""
    out, i = [], 0
    while i < len(words):
        letter = _starts(words, i, _LETTERS)
        if letter:
            symbol, i = letter
            out.append(symbol)
        elif words[i] in _DIGIT_WORDS:
            j = _run(words, i, _DIGIT_WORDS)
            out.append(read_digits(words[i:j]))
            i = j
        elif re.fullmatch("[A-Za-z0-9]+", words[i]):
            out.append(words[i].upper())
            i += 1
        else:
            raise Miss(f"no letter or digit: {words[i]!r}")
    if not out:
        raise Miss("nothing to spell")
    return "".join(out)


# --- numbers ----------------------------------------------------------------------------------------------------


def cardinal(words: Words) -> str:
    sign, words = signed(words)
    return sign + grouped(read_cardinal(words))


def ordinal(words: Words) -> str:
    lead = words[0] if words[0] in ("thứ", "hạng", "số") else ""
    rest = words[1:] if lead else words
    value = {"nhất": 1, "nhì": 2}.get(" ".join(rest)) or read_number(rest)
    return f"{lead} {value}".strip()


def decimal(words: Words) -> str:
    sign, words = signed(words)
    parts = _cut(words, L.COMMA_WORDS)
    if not parts or not all(parts):
        raise Miss("no decimal comma between two parts")
    whole, part = parts
    whole = grouped(read_cardinal(whole)) if any(w in L.STRUCTURE for w in whole) else read_digits(whole)
    return f"{sign}{whole},{read_digits(part)}"


def plain_or_decimal(words: Words) -> str:
    return decimal(words) if L.COMMA_WORDS & set(words) else cardinal(words)


def _two(words: Words, marks: set[str], read: Callable[[Words], object], sep: str) -> str:
    parts = _cut(words, marks)
    if not parts or not all(parts):
        raise Miss("no two parts")
    return f"{read(parts[0])}{sep}{read(parts[1])}"


def percent(words: Words) -> str:
    found = _ends(words, [(["phần", "trăm"], "%"), (["phần_trăm"], "%")])
    if not found:
        raise Miss("no percent at the end")
    return plain_or_decimal(found[0]) + "%"


def span_of(words: Words) -> str:
    return _two(words[1:] if words[0] in ("từ", "khoảng") else words, {"đến", "tới", "-"}, plain_or_decimal, "-")


def version(words: Words) -> str:
    first = next((i for i, w in enumerate(words) if w in L.NUMBER_WORDS or w in L.DOT_WORDS or w == "."), len(words))
    head, rest = words[:first], [w for w in words[first:] if w not in L.VERSION_WORDS]
    label = "" if all(w in L.VERSION_WORDS for w in head) else " ".join(L.VERSION_MARKS.get(w, w[:1].upper() + w[1:]) for w in head)
    parts: list[Words] = [[]]
    for w in rest:
        if w in L.DOT_WORDS or w == ".":
            parts.append([])
        else:
            parts[-1].append(w)
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    if len(parts) < 2 or not all(parts):
        raise Miss("a version has two parts or more")
    value = ".".join(str(read_cardinal(p)) if any(w in L.STRUCTURE for w in p) else read_digits(p) for p in parts)
    return value if not label else label + value if label.split()[-1] == "v" else f"{label} {value}"


# --- quantities -------------------------------------------------------------------------------------------------


@lru_cache(1)
def _per() -> list[tuple[Words, str]]:
    return sorted(((f"{lead} {unit}".split(), symbol) for unit, symbol in L.PER_UNITS.items() for lead in L.PER_LEADS), key=lambda x: -len(x[0]))


def quantity(words: Words) -> tuple[str, str]:
    """Value and unit; the longest unit that leaves a value wins."""
    for rest, per in [x for x in [_ends(words, _per())] if x] + [(words, "")]:
        found = _ends(rest, _UNITS)
        if found:
            return plain_or_decimal(found[0]), found[1] + (f"/{per}" if per else "")
    raise Miss("no unit (đơn vị) after a value")


def written_quantity(value: str, unit: str) -> str:
    return value + unit if unit.startswith("°") or unit == "%" else f"{value} {unit}"


def measure(words: Words) -> str:
    return written_quantity(*quantity(words))


def measured(kind: str) -> Callable[[Words], str]:
    def read(words: Words) -> str:
        value, unit = quantity(words)
        unit = L.KNOTS.get(unit, unit) if kind == "SPEED" else unit
        if unit not in L.UNIT_SETS[kind]:
            raise Miss(f"{unit} is no unit of {kind}")
        return written_quantity(value, unit)

    return read


def money(words: Words) -> str:
    found = _ends(words, _CURRENCIES)
    if not found:
        raise Miss("no currency")
    return f"{plain_or_decimal(found[0])} {found[1]}"


def channel(words: Words) -> str:
    lead = L.CHANNELS.get(words[0], "")
    rest = words[1:] if lead else words
    value = read_digits(rest) if rest[:1] == ["không"] and len(rest) > 1 else str(read_number(rest))
    return f"{lead} {value}".strip()


# --- date and time ----------------------------------------------------------------------------------------------


def _in(ways: Iterator[tuple[int, int]], lo: int, hi: int) -> Iterator[tuple[int, int]]:
    return ((v, j) for v, j in ways if lo <= v <= hi)


def _year(words: Words) -> int | None:
    words = words[1:] if words[:1] == ["năm"] else words
    try:
        y = read_year(words)
    except (Miss, IndexError):
        return None
    return y if 1000 <= y <= 2999 else None


def _dates(words: Words) -> Iterator[str]:
    """All readings, from the most marked to the least."""
    n = len(words)
    if "tháng" in words:
        at = words.index("tháng")
        days = [f"{v:02d}/" for v, j in _in(small(words, 0), 1, 31) if j == at] if at else [""]
        for day in days:
            for m, j in _in(small(words, at + 1), 1, 12):
                if j == n:
                    yield f"{day}{m:02d}"
                elif year := _year(words[j:]):
                    yield f"{day}{m:02d}/{year}"
        return
    if words[0] != "năm":  # day, month and year without words between
        for d, i in _in(small(words, 0), 1, 31):
            for m, j in _in(small(words, i), 1, 12):
                if j < n and words[j] != "năm" and (year := _year(words[j:])):
                    yield f"{d:02d}/{m:02d}/{year}"
    if year := _year(words):
        yield str(year)
    for d, i in _in(small(words, 0), 1, 31):
        if i == n:
            yield f"{d:02d}"
        elif words[i] == "năm" and (year := _year(words[i:])):
            yield f"{d:02d}/{year}"


def date(words: Words) -> str:
    words = [w for w in words if w not in (",", ".")]
    while words and words[0] in L.DAY_WORDS:
        words = words[1:]
    found = next(_dates(words), None) if words else None
    if found is None:
        raise Miss("no date")
    return found


def _bounded(words: Words, most: int, what: str) -> int:
    v = read_number(words)
    if v > most:
        raise Miss(f"{what} {v} is beyond {most}")
    return v


def time(words: Words) -> str:
    parts = _cut(words, {"giờ", "h"})
    if not parts or not parts[0]:
        raise Miss("no hour (giờ)")
    hour, rest = _bounded(parts[0], 23, "hour"), parts[1]
    if rest == ["rưỡi"]:
        return f"{hour:02d}:30"
    second = None
    if rest[-1:] == ["giây"]:
        body = rest[:-1]
        split = _cut(body, {"phút"})
        minutes, seconds = split if split else ([], body)
        second, rest = _bounded(seconds, 59, "second"), minutes
    rest = rest[:-1] if rest[-1:] == ["phút"] else rest
    minute = _bounded(rest, 59, "minute") if rest else 0
    return f"{hour:02d}:{minute:02d}" + ("" if second is None else f":{second:02d}")


def timezone(words: Words, books) -> str:
    for i, w in enumerate(words):
        if w in L.ZONE_SIGNS:
            label = _zone(words[:i], books) or "UTC"
            return f"{label}{L.ZONE_SIGNS[w]}{_bounded(words[i + 1 :], 14, 'offset')}"
    label = _zone(words, books)
    if not label:
        raise Miss("no time zone")
    return label


def _zone(words: Words, books) -> str | None:
    text = " ".join(words)
    known = next((label for label, forms in L.ZONES.items() if text in forms), None)
    if known:
        return known
    label, score, _ = books["acronyms"].lookup(text, fuzzy=False)
    return label if label and score >= 1.0 else None


def labelled_time(label: str) -> Callable[[Words], str]:
    forms, triggers = L.ETA_ETD[label]
    table = _table({label: forms})

    def read(words: Words) -> str:
        lead = _starts(words, 0, table)
        first = next((i for i, w in enumerate(words) if w in _DIGIT_WORDS), 0)
        rest = words[lead[1] :] if lead else words[first:] if set(triggers) <= set(words[:first]) else words
        return f"{label} {time(rest)}"

    return read


def duration(words: Words) -> str:
    """number unit, number unit, ... with năm as a unit or as 5, whichever leaves nothing over."""

    def ways(i: int) -> Iterator[str]:
        if i == len(words):
            yield ""
        for v, j in number(words, i):
            if j < len(words) and words[j] in L.DURATION_UNITS:
                for rest in ways(j + 1):
                    yield f"{v} {words[j]} {rest}".strip()

    found = next(ways(0), None)
    if not found:
        raise Miss("no duration")
    return found


def quarter(words: Words) -> str:
    v = read_number([w for w in words if w not in ("quý", "quí")])
    if not 1 <= v <= 4:
        raise Miss(f"no quarter {v}")
    return f"Quý {L.ROMAN[v - 1]}"


# --- position ---------------------------------------------------------------------------------------------------


def _angle(words: Words, direction: str) -> str:
    parts = _cut([w for w in words if w not in L.AXIS_WORDS], {"độ"})
    if not parts or not parts[0]:
        raise Miss("no degrees (độ)")
    degree, rest = read_number(parts[0]), parts[1]
    out = f"{degree:0{3 if direction in 'EW' else 2}d}°"
    minutes, seconds = rest, []
    if split := _cut(rest, {"phút"}):
        minutes, seconds = split
    elif rest[-1:] == ["giây"]:
        raise Miss("seconds without minutes")
    if seconds[-1:] == ["giây"]:
        seconds = seconds[:-1]
    if minutes:
        if L.COMMA_WORDS & set(minutes):
            if seconds:
                raise Miss("decimal minutes with seconds")
            whole, part = _cut(minutes, L.COMMA_WORDS)
            out += f"{_bounded(whole, 59, 'minute'):02d}.{read_digits(part)}′"
        else:
            v = read_number(minutes)
            if v >= 60 and seconds:
                raise Miss("decimal minutes with seconds")
            if v >= 60:
                if v // 1000 > 59:
                    raise Miss(f"minute {v}")
                out += f"{v // 1000:02d}.{v % 1000:03d}′"
            else:
                out += f"{v:02d}′"
    if seconds:
        out += f"{_bounded(seconds, 59, 'second'):02d}″"
    return out + direction


def coordinate(words: Words) -> str:
    out, part = [], []
    for w in words:
        if w in L.DIRECTIONS and part:
            out.append(_angle(part, L.DIRECTIONS[w]))
            part = []
        elif w not in (",",):
            part.append(w)
    if part and any(w not in L.AXIS_WORDS for w in part) or not out:
        raise Miss("no direction at the end")
    return ", ".join(out)


def heading(words: Words) -> str:
    rest = [w for w in words if w not in L.BEARING_WORDS]
    return f"{_bounded(rest, 359, 'heading'):03d}°"


# --- identifiers ------------------------------------------------------------------------------------------------


def _without_prefix(kind: str, words: Words) -> tuple[bool, Words]:
    lead = _starts(words, 0, _table({kind: L.ID_PREFIXES[kind]}))
    return bool(lead), words[lead[1] :] if lead else words


def mmsi(words: Words) -> str:
    return read_digits(_without_prefix("MMSI_ID", words)[1])


def imo(words: Words) -> str:
    had, rest = _without_prefix("IMO_ID", words)
    return ("IMO " if had else "") + read_digits(rest)


def telephone(words: Words) -> str:
    plus = words[0] in ("cộng", "+")
    digits = read_digits(_without_prefix("TELEPHONE", words[1:] if plus else words)[1])
    if plus:
        if len(digits) < 3:
            raise Miss("no subscriber number")
        return f"+{digits[:2]} " + " ".join(re.findall(".{1,3}", digits[2:]))
    if digits[:4] in ("1900", "1800") and len(digits) > 4:
        return f"{digits[:4]} {digits[4:]}"
    return digits


def callsign(words: Words) -> str:
    return spell([w for w in words if w not in L.CALL_WORDS])


def port_code(words: Words, books) -> str:
    found, _, _ = books["port_codes"].lookup(" ".join(words), fuzzy=False)  # a near miss could name another port
    return found or spell(words)


def _whole_or_spelled(words: Words) -> str:
    if not all(w in L.NUMBER_WORDS for w in words):
        return spell(words)
    return str(read_year(words)) if words[:2] == ["hai", "không"] and len(words) > 2 else str(read_number(words))


def _joined(words: Words, tables: list, year: bool, read: Callable[[Words], str]) -> str:
    """Groups between spoken separators; năm may stand for / before a year."""
    out, part, i = "", [], 0
    while i < len(words):
        mark = next((m for t in tables if (m := _starts(words, i, t))), None)
        if not mark and year and words[i] == "năm" and part:
            j = _run(words, i + 1, L.NUMBER_WORDS)
            try:
                mark = ("/", i + 1) if words[i + 1 : i + 2] not in (["mươi"], ["mười"]) and 1900 <= read_number(words[i + 1 : j]) <= 2100 else None
            except Miss:
                mark = None
        if mark:
            if not part:
                raise Miss("a separator without a part before it")
            out, part, i = out + read(part) + mark[0], [], mark[1]
        else:
            part.append(words[i])
            i += 1
    if not part:
        raise Miss("a separator without a part behind it")
    return out + read(part)


def document_id(words: Words) -> str:
    lead = words[0] == "số"
    rest = words[1:] if lead else words
    if not rest:
        raise Miss("no number of a document")
    return ("Số " if lead else "") + _joined(rest, [_SLASHES, _DASHES], True, _whole_or_spelled)


def legal_document(words: Words, books) -> str:
    bare = []  # words and whether they are a spoken dash or slash
    i = 0
    while i < len(words):
        mark = _starts(words, i, _DASHES) or _starts(words, i, _SLASHES)
        j = mark[1] if mark else i + 1
        bare += [(w, bool(mark)) for w in words[i:j]]
        i = j
    for k in range(len(words)):
        tail = " ".join(w for w, is_mark in bare[k:] if not is_mark)
        found, score, _ = books["legal_docs"].lookup(tail, fuzzy=False) if tail and not bare[k][1] else (None, 0.0, "")
        if found and score >= 1.0:
            head = words[:k]
            while head and bare[len(head) - 1][1]:
                head = head[:-1]
            return f"{document_id(head)}/{found}" if head else found
    found, score, _ = books["legal_docs"].lookup(" ".join(words))
    if not found:
        raise Miss(f"not in the catalogue (danh mục): best {score:.2f}")
    return found


def plate(words: Words) -> str:
    def group(part: Words) -> str:
        return str(read_number(part)) if all(w in L.NUMBER_WORDS for w in part) and {"trăm", "nghìn", "ngàn"} & set(part) else spell(part)

    text = _joined(words, [_DASHES, [(["dấu", "chấm"], "."), (["chấm"], ".")]], False, group)
    bare = re.fullmatch(r"([0-9]{2})([A-Z]{1,2})([0-9]{4,5})", text)
    text = "{}{}-{}".format(*bare.groups()) if bare else text
    if not re.fullmatch(r"[0-9]{2}[A-Z]{1,2}-([0-9]{3}\.[0-9]{2}|[0-9]{4,5})", text):
        raise Miss(f"{text!r} is no plate")
    return text


def _block(lead: str, words: Words) -> str:
    code = _joined(words, [_DASHES, [(["trừ"], "-")]], False, spell)
    if not re.search("[0-9]", code):
        raise Miss("a block without a number")
    return f"{lead} {code}"


def _address_atoms(words: Words) -> Iterator[tuple[str, str]]:
    """(N, number), (S, words for a slash), (W, another word), and words that begin a part: P of a place with a name, H of a
    house, O of others."""
    i = 0
    while i < len(words):
        w, j = words[i], _run(words, i, L.NUMBER_WORDS)
        slash = _starts(words, i, _SLASHES)
        if j > i:
            yield "N", str(read_number(words[i:j]))
        elif slash:
            j = slash[1]
            yield "S", " ".join(words[i:j])
        else:
            j = i + 1
            city = words[i : i + 2] == ["thành", "phố"]  # alone the first of these is a part of a name
            yield "O" if city else "H" if w == "số" else "P" if w in L.PLACE_WORDS else "O" if w in L.OTHER_ADDRESS_WORDS else "W", w
        i = j


#: A part is a word that begins it, if any, and what follows up to the next.
_ADDRESS_PART = re.compile("([PHO]?)([NSW]*)")


def address(words: Words) -> str:
    """A block with its code, or parts: a house with its number and the street's name, places with theirs, and others."""
    if words[0] in L.BLOCKS and len(words) > 1:
        return _block(L.BLOCKS[words[0]], words[1:])
    atoms = list(_address_atoms(words))
    shown = []
    for part in _ADDRESS_PART.finditer("".join(kind for kind, _ in atoms)):
        house = part[1] == "H" and part[2].startswith("N")
        named = house or part[1] == "P"
        if part[1]:
            shown.append("Số" if part[1] == "H" and part.start() == 0 else atoms[part.start()][1])
        for piece in re.finditer("N(?:SN)*|." if house else ".", part[2]):
            own = [text for _, text in atoms[part.start(2) + piece.start() : part.start(2) + piece.end()]]
            if piece[0].startswith("N"):
                shown.append("/".join(own[::2]))
            else:
                shown += [w[:1].upper() + w[1:] if named else w for w in own[0].split()]
    text = " ".join(shown)
    if not re.search("[0-9]", text):
        raise Miss("an address without a number")
    return text


# --- electronic addresses ---------------------------------------------------------------------------------------

SUBTYPES = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("MAC", r"([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}"),
    ("IPV4", r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|0{0,2}[0-9]|0?[1-9][0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|0{0,2}[0-9]|0?[1-9][0-9])"),
    ("URL", r"(https?://)?(www\.)?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(/\S*)?"),
]


def subtype(text: str) -> str | None:
    found = next((name for name, shape in SUBTYPES if re.fullmatch(shape, text)), None)
    if found is None and text.count(":") >= 2:
        try:
            return "IPV6" if IPv6Address(text) else None
        except ValueError:
            return None
    return found


def _address_reading(words: Words, colons: int) -> str:
    """Symbols, numbers, letters, ASCII pieces and syllables. hai chấm is a colon the first times, so many as colons says, and
    2 and a dot later: in no address is a colon behind such a dot."""
    out, i = [], 0
    while i < len(words):
        mark = _starts(words, i, _SYMBOLS)
        if mark and (words[i] not in L.NUMBER_WORDS or colons > 0):
            colons -= words[i] in L.NUMBER_WORDS
            symbol, i = mark
            out.append(symbol)
        elif words[i] in L.NUMBER_WORDS:
            j = then = _run(words, i, L.NUMBER_WORDS)
            colon = words[j - 1 : j + 1] == ["hai", "chấm"] and j - 1 > i and colons > 0
            if colon:
                j, then, colons = j - 1, j + 1, colons - 1
            run = words[i:j]
            out.append(str(read_cardinal(run)) if any(w in L.STRUCTURE for w in run) else read_digits([w for w in run if w != "lẻ"]))
            out.append(":" if colon else "")
            i = then
        else:
            letter = _starts(words, i, _LETTERS)
            plain = words[i] if re.fullmatch(r"[A-Za-z0-9._%+:/@-]+", words[i]) else keys.fold(words[i])
            piece, i = (letter[0].lower(), letter[1]) if letter else (plain.lower(), i + 1)
            if not re.fullmatch(r"[a-z0-9._%+:/@-]+", piece):
                raise Miss(f"no part of an address: {piece!r}")
            out.append(piece)
    return "".join(out)


def _address_readings(words: Words) -> Iterator[str]:
    """All readings, those with more colons first, but before them four numbers with dots: the same words may be said for
    172.2.92.186 and for 170::90:186, and hai chấm is then 2 and a dot."""
    most = sum(words[i : i + 2] == ["hai", "chấm"] for i in range(len(words)))
    if most:
        try:
            plain = _address_reading(words, 0)
        except Miss:
            plain = ""
        if subtype(plain) == "IPV4":
            yield plain
    for colons in range(most, -1, -1):
        try:
            yield _address_reading(words, colons)
        except Miss:
            continue


def electronic(words: Words) -> str:
    text = " ".join(words)
    lead = next((x for x in L.PROTOCOL_LEADS if text.startswith(x + " ")), "")
    rest = text[len(lead) :].split()
    for stem in sorted(L.PROTOCOL_STEMS, key=len, reverse=True):
        s = stem.split()
        if rest[: len(s)] == s and rest[len(s) : len(s) + 1] in (["bốn"], ["sáu"]):
            tail = rest[len(s) + 1 :]
            return f"IPv{L.DIGITS[rest[len(s)]]}" + (f" {electronic(tail)}" if tail else "")
    compact = "".join(words)
    kind = subtype(compact)
    for reading in [compact] if kind else _address_readings(words):
        kind = kind or subtype(reading)
        if kind:
            return reading.upper() if kind == "MAC" else reading.lower() if kind in ("EMAIL", "URL") else reading
    raise Miss("no e-mail, web, IP or MAC address")


# --- entities ---------------------------------------------------------------------------------------------------


def from_books(*names: str) -> Callable:
    def read(words: Words, books) -> str:
        best = 0.0
        for name in names:
            found, score, _ = books[name].lookup(" ".join(words))
            if found:
                return found
            best = max(best, score)
        raise Miss(f"not in the catalogue (danh mục): best {best:.2f}")

    return read


_PREFIXES = _table(catalogues.EQUIPMENT_PREFIXES)


def equipment_id(words: Words, books) -> str:
    found, score, _ = books["equipment"].lookup(" ".join(words), fuzzy=False)
    if found and score >= 1.0:
        return found
    lead = _starts(words, 0, _PREFIXES)
    if not lead:
        raise Miss("no known equipment")
    prefix, i = lead
    dash = _starts(words, i, _DASHES)
    i = dash[1] if dash else i
    j = _run(words, i, L.NUMBER_WORDS)
    if j == i:
        raise Miss("equipment without a number")
    suffix = spell(words[j:]) if j < len(words) else ""
    return f"{prefix}-{read_number(words[i:j])}{suffix}"


def title(words: Words) -> str:
    return " ".join(w[:1].upper() + w[1:].lower() for w in " ".join(words).replace("_", " ").split())


def rank(words: Words) -> str:
    if all(w.lower() in L.ENGLISH_RANKS for w in words):
        return title(words)
    text = " ".join(words).replace("_", " ").lower()
    return text[:1].upper() + text[1:]


NORMALIZERS: dict[str, Callable] = {
    "CARDINAL": cardinal, "ORDINAL": ordinal, "DIGIT_SEQ": read_digits, "DECIMAL": decimal, "FRACTION": lambda w: _two(w, {"phần"}, read_number, "/"),
    "PERCENT": percent, "RANGE": span_of, "RATIO": lambda w: _two(w, {"trên", "chọi", "so"}, read_number, ":"), "MONEY": money, "MEASURE": measure, "VERSION": version,
    "DATE": date, "TIME": time, "TIMEZONE": timezone, "DURATION": duration, "ETA": labelled_time("ETA"), "ETD": labelled_time("ETD"), "QUARTER": quarter,
    "COORD": coordinate, "HEADING": heading, "BEARING": heading, **{k: measured(k) for k in L.UNIT_SETS}, "CHANNEL": channel,
    "MMSI_ID": mmsi, "IMO_ID": imo, "TELEPHONE": telephone, "CALLSIGN": callsign, "VESSEL_ID": spell, "PORT_CODE": port_code, "DOCUMENT_ID": document_id,
    "LEGAL_DOC_ID": legal_document, "ELECTRONIC": electronic, "VEHICLE_PLATE": plate, "ADDRESS": address,
    "EQUIPMENT_ID": equipment_id, "EQUIPMENT_NAME": from_books("foreign_names", "equipment"), "FOREIGN_NAME": from_books("foreign_names"), "ACRONYM": from_books("acronyms"),
    "MARITIME_TERM": from_books("maritime_terms"), "PERSON_NAME": title, "LOCATION_NAME": title, "RANK": rank,
}
WITH_BOOKS = {"TIMEZONE", "PORT_CODE", "LEGAL_DOC_ID", "EQUIPMENT_ID", "EQUIPMENT_NAME", "FOREIGN_NAME", "ACRONYM", "MARITIME_TERM"}


class Engine:
    """All normalisers over one set of catalogues; a catalogue that is missing fails only the types that need it."""

    def __init__(self, entries: dict[str, dict[str, list[str]]] | None = None, remember: int = 100_000):
        self.books = {name: catalogues.Catalogue(e) for name, e in (entries or catalogues.defaults()).items()}
        self.normalize = lru_cache(remember)(self._normalize)

    def _normalize(self, kind: str, text: str) -> tuple[str | None, bool, str]:
        """(written form, valid, reason); never raises."""
        words = (text or "").split()
        if kind not in NORMALIZERS:
            return None, False, f"no normalizer for {kind}"
        if not words:
            return None, False, "empty"
        try:
            out = NORMALIZERS[kind](words, self.books) if kind in WITH_BOOKS else NORMALIZERS[kind](words)
            return (out, True, "") if out else (None, False, "empty result")
        except Miss as e:
            return None, False, f"parser: {e}"
        except KeyError as e:
            return None, False, f"no catalogue {e}"
        except (IndexError, ValueError, RecursionError) as e:
            return None, False, f"parser: {e}"

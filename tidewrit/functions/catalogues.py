"""Catalogues: canonical forms with their spoken readings, and the four tiers of lookup."""

from __future__ import annotations

import json
from itertools import islice, product

from . import keys
from .lexicon import D_OR_DD, LETTERS

ACCEPT = 0.86

#: Acronyms that are spelled letter by letter. Other readings come from a file or table of the user.
ACRONYMS = "AI AIS AK ARPA ASEAN BHXH BHYT BIDV BQP BTL CAND CCCD CHQS CNXH CP CPA CSB CSGT DNS DQTV DSC ECDIS EPIRB GDP GIS GMDSS GMT GNSS GPS HĐND HF IFF IMO INS IP LLVT MARPOL MF MMSI MRCC NATO NAVTEX PCCC QĐND RADAR SAR SART SOLAS SONAR TCP TCPA UAV UBND UDP UHF UN UTC VDR VHF VOV VTS XHCN".split()

#: Canonical form and its readings.
FOREIGN_NAMES = {"Patriot": ["pa tri ốt", "pat ri ốt", "ba tri ốt", "patriot"], "Washington": ["oa sinh tơn"], "Tomahawk": ["tô ma hốc", "tô ma hoóc"], "Himars": ["hi mác", "hi mars"], "Drone": ["đờ rôn"]}
MARITIME_TERMS = {"MAYDAY": ["mây đây", "mê day", "mê đây"], "PAN-PAN": ["pan pan", "pang pang"], "SECURITE": ["sê cu ri tê", "sê kiu ri tê", "xê cu ri tê"], "dead slow ahead": ["đét slâu a hét", "đét sờ lô a hét", "đét xờ lâu a hét"], "slow ahead": ["slâu a hét", "sờ lô a hét", "xờ lâu a hét"], "half ahead": ["háp a hét"], "full ahead": [], "stop engine": [], "hard to port": [], "hard to starboard": [], "man overboard": [], "abandon ship": []}
PORT_CODES = {"VNHPH": ["vê en hát pê hát"], "VNSGN": ["vê en ét giê en"], "VNDAD": ["vê en đê a đê"], "VNCLI": ["vê en xê e lờ i"], "SGSIN": ["ét giê ét i en"], "CNSHA": ["xê en ét hát a"]}
LEGAL_DOCS = {"NĐ-CP": ["nờ đê cê pê", "nờ đê xê pê", "nghị định chính phủ", "nghị định của chính phủ"], "QĐ-TTg": ["quy đê tê tê giê", "quy đê tê tê gờ", "quyết định thủ tướng", "quyết định của thủ tướng"], "QĐ": ["quy đê"], "NQ": ["en quy", "nờ quy"], "CT": ["xê tê", "cê tê"], "CP": ["xê pê", "cê pê"], "TT": ["tê tê"], "TT-BTC": ["tê tê bê tê xê", "tê tê bê tê cê", "thông tư bộ tài chính", "thông tư của bộ tài chính"], "TT-BQP": ["tê tê bê quy pê", "thông tư bộ quốc phòng", "thông tư của bộ quốc phòng"], "KH": ["ka hát", "ca hát"], "NQ-CP": ["en quy cê pê", "nờ quy cê pê", "nghị quyết chính phủ"], "CT-TTg": ["cê tê tê tê giê", "chỉ thị thủ tướng"], "TT-BCA": ["tê tê bê cê a", "thông tư bộ công an"], "TT-BGTVT": ["thông tư bộ giao thông vận tải"], "QĐ-BQP": ["quy đê bê quy pê", "quyết định bộ quốc phòng"]}
#: Whole models, and prefixes that stand before a number.
EQUIPMENT = {"M16": ["em mười sáu"], "M4A1": ["em bốn a một"], "MU90": ["em u chín mươi"], "MK 46": ["em ca bốn sáu", "em ka bốn sáu"], "SET-65": ["ét e tê sáu lăm"], "53-65KE": ["năm ba sáu lăm ka e"]}
EQUIPMENT_PREFIXES = {"Su": ["su", "xu", "ét u"], "MiG": ["míc"], "Mi": ["mi", "em i"], "Kh": ["ka hát", "ca hát"], "AK": ["a ka", "a ca"], "F": ["ép"], "B": ["bê"], "RPG": ["rờ pê giê", "rờ pê gờ"], "T": ["tê"], "Ka": ["ka", "ca"], "P": ["pê"], "SET": ["ét e tê"]}


def spelled(acronym: str, most: int = 64) -> list[str]:
    """Readings of an acronym by the names of its letters, the first 64 of them: a longer acronym whose letters have several
    names each is also found by the later tiers, or read from a table."""
    names = [LETTERS.get(c, []) + ([D_OR_DD] if c in "DĐ" else []) for c in acronym]
    return [" ".join(x) for x in islice(product(*(n or [c.lower()] for n, c in zip(names, acronym))), most)] + [acronym.lower()]


class Catalogue:
    """Indexes of one catalogue. An equal key keeps its last reading, or else its first; folded and phonetic keys their first."""

    def __init__(self, entries: dict[str, list[str]]):
        self.exact: dict[str, str] = {}
        self.folded: dict[str, str] = {}
        self.phonetic: dict[str, str] = {}
        self.readings: list[tuple[str, str, str, bool]] = []
        for canonical, spoken in entries.items():
            for reading in spoken:
                self.exact[keys.spoken_key(reading)] = canonical
        for canonical, spoken in entries.items():
            self.exact.setdefault(keys.spoken_key(canonical), canonical)
            numbered = any(c.isdigit() for c in canonical)
            for reading in [*spoken, canonical]:
                key = keys.spoken_key(reading)
                self.folded.setdefault(keys.fold(key), canonical)
                if not numbered:
                    self.phonetic.setdefault(keys.phonetic_key(key), canonical)
                self.readings.append((key, keys.fold(key), canonical, numbered))

    def lookup(self, text: str, fuzzy: bool = True) -> tuple[str | None, float, str]:
        """The canonical form or None, the score and the tier."""
        key = keys.spoken_key(text)
        for tier, index, k, score in (("exact", self.exact, key, 1.0), ("folded", self.folded, keys.fold(key), 0.97), ("phonetic", self.phonetic, keys.phonetic_key(key), 0.94)):
            if k and k in index:
                return index[k], score, tier
        best, found = 0.0, None
        flat, sound, number = keys.fold(key), keys.phonetic_key(key), keys.signature(key)
        for own, own_flat, canonical, numbered in self.readings if fuzzy and key else []:
            if abs(len(own) - len(key)) > max(3, len(key) // 3) or numbered and keys.signature(own) != number:
                continue
            score = keys.ratio(flat, own_flat)
            if not numbered:
                score = max(score, keys.ratio(sound, keys.phonetic_key(own)))
            if score > best:
                best, found = score, canonical
        return (found, best, "fuzzy") if best >= ACCEPT else (None, best, "none")


def from_json(text: str) -> dict[str, list[str]]:
    """Entries of a catalogue file: {"entries" or "models": [{"canonical", "spoken": []}]}."""
    tree = json.loads(text)
    return {x["canonical"]: list(x["spoken"]) for x in tree.get("entries") or tree.get("models")}


def defaults() -> dict[str, dict[str, list[str]]]:
    return {"acronyms": {a: spelled(a) for a in ACRONYMS}, "foreign_names": FOREIGN_NAMES, "maritime_terms": MARITIME_TERMS, "port_codes": PORT_CODES, "legal_docs": LEGAL_DOCS, "equipment": EQUIPMENT}

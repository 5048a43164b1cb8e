import pytest
from goldens import SPANS

from tidewrit.functions import numbers
from tidewrit.functions.catalogues import Catalogue, defaults
from tidewrit.functions.lexicon import TYPES
from tidewrit.functions.normalizers import NORMALIZERS, Engine, subtype
from tidewrit.functions.validators import valid
from tidewrit.operators.normalize import attempt
from tidewrit.plans.verbalize import below_thousand

ENGINE = Engine()


@pytest.mark.parametrize("kind,text,want", SPANS)
def test_span(kind, text, want):
    assert ENGINE.normalize(kind, text)[0] == want


def test_every_type_has_a_normalizer_and_never_raises():
    assert sorted(NORMALIZERS) == sorted(TYPES) and len(TYPES) == 46
    for kind in TYPES:
        for text in ("", " ", "a", "năm", "hai chấm", "gạch", "không", "x" * 500, "một " * 60, "\t"):
            out, ok, reason = ENGINE.normalize(kind, text)
            assert ok == (out is not None) and (ok or reason)


def test_numbers_round_trip():
    for n in range(1000):
        assert numbers.read_cardinal(below_thousand(n, False).split() or ["không"]) == n
        assert numbers.read_cardinal(["một", "nghìn", *below_thousand(n, True).split()]) == 1000 + n if n else True


def test_missing_catalogue_fails_its_types_only():
    e = Engine({"acronyms": {}})
    assert e.normalize("EQUIPMENT_ID", "su ba mươi")[1] is False
    assert e.normalize("CARDINAL", "hai mươi")[0] == "20"


def test_siblings_have_validators():
    assert attempt(ENGINE, "MMSI_ID", "không chín không tám một hai ba bốn năm sáu") == ("0908123456", True, "", "TELEPHONE")
    assert attempt(ENGINE, "MMSI_ID", "một hai ba")[1] is False


def test_lookup_tiers_and_the_safety_rule():
    c = Catalogue(defaults()["foreign_names"])
    assert c.lookup("pa tri ốt")[1:] == (1.0, "exact")
    assert c.lookup("pa tri ót")[1:] == (0.97, "folded")
    assert c.lookup("cờ lô ri ban đờ")[0] is None
    numbered = Catalogue({"AK-47": ["a ka bốn mươi bảy"], "AK-101": ["a ka một trăm lẻ một"]})
    assert numbered.lookup("a ca bốn mươi tám")[0] is None  # another number is another model
    assert numbered.lookup("a ca bốn mươi bảy")[0] == "AK-47"


def test_subtypes():
    for text, want in [("vts@portcontrol.vn", "EMAIL"), ("www.vinamarine.gov.vn", "URL"), ("192.168.10.25", "IPV4"), ("2001:db8:100::25", "IPV6"), ("00:1A:2B:3C:4D:5E", "MAC"), ("1:2:3", None), ("300.1.1.1", None)]:
        assert subtype(text) == want


def test_validators():
    for kind, text, want in [("COORD", "10°25'N", True), ("COORD", "10°25′30″N, 107°08′15″E", True), ("COORD", "95°25'N", False), ("COORD", "190°08'E", False), ("COORD", "107°08'E", True), ("HEADING", "360°", False), ("MMSI_ID", "12345678", False), ("IMO_ID", "IMO 9074729", True), ("PORT_CODE", "VNHP", False), ("VEHICLE_PLATE", "30A-123.45", True), ("MEASURE", "120 m³/h", True), ("PERSON_NAME", "x", True)]:
        assert valid(kind, text) is want

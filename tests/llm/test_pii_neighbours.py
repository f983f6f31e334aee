"""Personal values beside other digits and words."""

from palisade.llm import pii


def found(text):
    new, kinds, n = pii.rewrite(text, pii.Cipher(b"k"))
    return new, kinds, n


def test_values_beside_others():
    card, iban, plain = "4111111111111111", "AT611904300234573201", "743-555-3824"
    for text in (f"{card} 123", f"{card} 12/27", f"123 {card}", f"{card} 2027-12-01", "4111 1111 1111 1111 123"):
        new, kinds, _ = found(text)
        assert "card" in kinds and card not in new.replace(" ", "")
    assert found(f"{card} 123")[0].endswith(" 123") and found(f"123 {card}")[0].startswith("123 ")
    new, kinds, _ = found(f"{iban} ABCD")
    assert kinds == ["iban"] and iban not in new and new.endswith(" ABCD")
    for text in (plain, plain.replace("-", "."), plain.replace("-", " "), f"call {plain}, or"):
        new, kinds, n = found(text)
        assert (kinds, n) == (["phone"], 1) and len(new) == len(text) and new != text
        assert found(new)[1] == ["phone"]
    assert found("4111111111111112 123")[2] == found("1.743.555.3824.9")[2] == 0

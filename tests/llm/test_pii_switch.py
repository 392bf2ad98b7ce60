import pytest

from kataloom.llm.pii import NameModel, find

MODEL = NameModel(["Wiraka", "Wirana"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("kirim ke budi[a]contoh.id ya", ["email"]), ("budi{a}contoh.id", ["email"]), ("budi { at } contoh.id", ["email"]), ("budi et contoh dot id", ["email"]),
        ("budi\tat\tcontoh dot id", ["email"]), ("budi\nat\ncontoh.id", ["email"]), ("budi( a )contoh.id", ["email"]), ("wa ٠٨١٢٣٤٥٦٧٨٩٠ ya", ["phone"]), ("nik ३५०१२२५६०४०९००१०", ["id_number"]),
        ("Jl. Melati Raya No. १२", ["address"]), ("nik ३५०१२२७२०४०९००१०", []), ("makan di pasar at home", []), ("skor ٣ ke ٤", []),
    ],
)
def test_switches_let_through_what_the_patterns_accept(text, want):
    assert [k for _, _, k, _ in find(text, MODEL)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        # Cards: the Luhn digit decides.
        ("kartu kredit 4539 5787 6362 1486", ["card"]), ("kartu kredit 4539 5787 6362 1487", []), ("bayar 4539578763621486 ya", ["card"]), ("bayar 4539578763621476 ya", []), ("378282246310005", ["card"]), ("378282246310006", []),
        # 16 digits that can be both: context, then the date before the Luhn digit.
        ("nik 3501225604090010", ["id_number"]), ("kartu kredit 3501 2256 0409 0010", ["card"]), ("kartu kredit 3501 2256 0409 0011", []), ("3501225604090010", ["id_number"]), ("3501997604090014", ["card"]), ("3501997604090015", []),
        # Accounts: the mod-97 digits decide.
        ("rek GB82 WEST 1234 5698 7654 32", ["account"]), ("rek GB83 WEST 1234 5698 7654 32", []), ("DE89370400440532013000", ["account"]), ("DE89370400440532013001", []),
        ("rek GB82 WEST 1234 5698 7654 32", ["account"]), ("resi GB82WEST12345698765432", []),
        # Spelled digits without the words that used to be looked for first.
        ("enam dua satu dua tiga empat lima enam tujuh satu", ["phone"]), ("satu dua tiga empat lima enam tujuh delapan sembilan", []), ("kosong sembilan satu dua tiga empat lima enam tujuh", ["phone"]),
    ],
)
def test_check_digits_decide(text, want):
    assert [k for _, _, k, _ in find(text, MODEL)] == want

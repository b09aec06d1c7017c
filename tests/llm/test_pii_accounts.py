"""Account numbers with words behind them and cues without a sign."""

import pytest

from freshet.llm import pii


def accounts(text):
    return [text[a:b] for k, a, b in pii.spans(text, pii.automaton()) if k == "account"]


@pytest.mark.parametrize("number", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"])
@pytest.mark.parametrize("before", ["", "pay ", "IBAN: ", "IBAN ", "iban no. "])
@pytest.mark.parametrize("behind", ["", " Please", " 5 days", " A B 12", ".", " PLEASE PAY", "\nX1"])
def test_account_number_ends_where_it_ends(number, before, behind):
    text = before + number + behind
    assert accounts(text) == [number]
    assert pii.masked(text, [s for s in pii.spans(text, pii.automaton()) if s[0] == "account"]) == f"{before}<ACCOUNT>{behind}"


def test_country_without_known_length_and_wrong_remainder():
    body = "1234567890123456"
    check = 98 - int(body + "353500") % 97  # the letters ZZ are 35 35
    number = f"ZZ{check:02d}{body}"
    assert accounts(f"to {number} Now") == [number]
    assert accounts("to DE88370400440532013000 Now") == [] and accounts("DE89370400440532013000P") == []


@pytest.mark.parametrize("text, want", [
    ("account number 12345678 is", ["12345678"]), ("Account No. 12345678", ["12345678"]), ("acct no: 12-345-678 x", ["12-345-678"]),
    ("account 12345678", ["12345678"]), ("account: 1234 5678 9012 Please", ["1234 5678 9012"]), ("passport number C01X00T47", ["C01X00T47"]), ("passport number C01X00TAB", []),
    ("passport number: C01X00T47", ["C01X00T47"]), ("account of 12345678", []), ("accounts 12345678", []), ("account now 12345678", []),
    ("the account", []), ("account number", []), ("token: ab", []), ("account nothing2you", []),
])
def test_cues(text, want):
    assert accounts(text) == want

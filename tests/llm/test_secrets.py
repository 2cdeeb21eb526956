"""Credential values of any length and under joined names are whole candidates, and nothing of them stays in the text."""

from __future__ import annotations

import random
import time

import pytest

from graphloom.llm import pii

from .conftest import SCHEMA, prose, row


def values(text):
    return [text[a:b] for family, a, b in pii.candidates(text) if family == "secret"]


@pytest.mark.parametrize("name", ["token", "access_token", "auth_token", "AWS_SECRET_ACCESS_KEY", "my_api_key", "db_password"])
@pytest.mark.parametrize("size", [8, 128, 129, 240, 3000])
def test_whole_values_are_candidates(name, size):
    value = ("aB3.x_Z9-" * size)[:size]
    assert value in values(f"word {name} = {value} word")


def test_other_words_are_not_names():
    assert values("tokens = abcdefgh12 mytoken = abcdefgh12 token = short") == []


def test_long_runs_are_linear():
    start = time.time()
    assert values("token=" + "a" * 1_000_000) == ["a" * 1_000_000]
    assert values("token_" * 200_000) == [] and time.time() - start < 10


def test_nothing_of_a_long_value_stays(spark):
    r = random.Random(7)
    token = lambda n: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(n))
    rows = [row(i, f"{prose(i, 10)} {'access_token' if i % 2 else 'token'} = {token(40 if i % 4 else 240)} {prose(i + 1, 5)}") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = {x.doc_id: x.text for x in pii.redact(docs, pii.fit(docs)).collect()}
    assert all(clean[i] == f"{prose(i, 10)} {'access_token' if i % 2 else 'token'} = [SECRET] {prose(i + 1, 5)}" for i in clean)


def test_names_and_hosts_of_any_length_are_proposed_whole():
    long = "x" * 90 + " (at) example.com"
    assert ("address", 0, len(long)) in pii.candidates(long)
    deep = "me@" + ".".join("abcdefghi") + ".org"
    assert ("address", 0, len(deep)) in pii.candidates(f"{deep} here")
    label = "me@" + "l" * 80 + ".org"
    assert ("address", 0, len(label)) in pii.candidates(label)


def test_spoken_and_short_secrets_and_hardware_addresses_are_proposed():
    assert ("secret", 12, 22) in pii.candidates("password is hunter2abc")
    assert ("secret", 4, 11) in pii.candidates("pwd=abc1234")
    assert ("number", 4, 21) in pii.candidates("mac 0a:1B:2c:3d:4e:5f.")


def test_generators_stay_linear():
    for text in ("a@" * 200_000, "x" * 400_000 + "@" + "y." * 200_000, "a at b " * 60_000, "password is " * 40_000, "0a:" * 150_000):
        began = time.time()
        pii.candidates(text)
        assert time.time() - began < 10

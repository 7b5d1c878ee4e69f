"""Tokenisers against character scanners, literal results and properties."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import elements as E
from tagloom.functions import text as T

PIECES = list("aAbBZz019_ ()\"'/*\\\n\té  $.-&!|,:<>=+[]") + ["if", "for", "//", "/*", "*/", "HTTP", "Req", "\\t", "\\n", " (", "12"]


@pytest.fixture(scope="module")
def strings(spark):
    rng = random.Random(11)
    rows = [("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))),) for _ in range(3000)]
    rows += [("/* only */ // comments",), ("/* open",), ("\"open ' x",), ("a // x  y\nb",), ("é12_34 1_2",), ("",), ("a\ufdd0b\ufdd1c // x",)]
    return spark.createDataFrame(rows, "t string").cache()


def scan_comments(text):
    """One character after the other: comments out, quoted literals whole."""
    out, i = "", 0
    while i < len(text):
        if text.startswith("//", i):
            end = text.find("\n", i)
            out, i = out + " ", len(text) if end < 0 else end
        elif text.startswith("/*", i) and text.find("*/", i + 2) >= 0:
            out, i = out + " ", text.find("*/", i + 2) + 2
        elif text[i] in "'\"":
            j = i + 1
            while j < len(text) and text[j] != text[i]:
                j += 2 if text[j] == "\\" else 1
            end = j + 1 if j < len(text) else i + 1  # without its closing mark it is a character
            out, i = out + text[i:end], end
        else:
            out, i = out + text[i], i + 1
    return out


def scan_words(text):
    """Letters and digits in runs, cut where upper case begins a word, in lower case."""
    runs, run = [], ""
    for c in text + " ":
        if c.isascii() and c.isalnum():
            run += c
        elif run:
            runs.append(run)
            run = ""
    out = []
    for run in runs:
        if run.isdigit():
            continue
        word = ""
        for i, c in enumerate(run):
            after = run[i + 1] if i + 1 < len(run) else ""
            starts = c.isupper() and (not run[i - 1].isupper() or ("a" <= after <= "z")) if i else False
            if starts and word:
                out.append(word)
                word = ""
            word += c
        out.append(word)
    return [w.lower() for w in out]


def values(frame, expression):
    return [(r.t, r.got) for r in frame.select("t", expression(F.col("t")).alias("got")).collect()]


def test_comments(strings):
    for text, got in values(strings, T.remove_comments):
        assert got == scan_comments(text), repr(text)


def test_identifier_parts(strings):
    for text, got in values(strings, T.split_identifier):
        assert got == scan_words(text), repr(text)


def test_identifiers_and_calls(strings):
    """Every token is a part of the text, once, and a name of its own gives all its parts."""
    for text, got in values(strings, E.identifiers):
        assert len(got) == len(set(got)) and all(g in text.lower() for g in got)
    for text, got in values(strings, E.calls):
        assert len(got) == len(set(got)) and ("(" in text or not got)
    for text, got in values(strings, E.controls):
        assert got == [k for k in E.CONTROL_WORDS if k in got] and all(k in text for k in got)


@pytest.mark.parametrize("expression,text,expected", [
    (T.code_tokens, 'int readFile(char *p) { /* no */ return log("a b", p2_x); } // end', "int read file char p return log strlitplaceholder p2 x"),
    (T.code_tokens, "HTTPServer2Go x1y 12 34a 'c' // HTTPServer", "http server2 go x1y 34a c"),
    (T.code_tokens_legacy, 'x1 = "a" + b2C("d"); /* e */ fooBar', "x strlitplaceholder foo bar"),
    (T.letters_tokens_legacy, "ab12cd EFGh 3 i_j", "abcd ef gh i j"),
    (E.identifiers, "9lives getURL _tmp_1 getURL x", "lives get url tmp x"),
    (E.calls, "if (a) doThis (b); that(c) + sizeof(d) thatToo", "do this that"),
    (E.controls, "while(x) if (y) return; iffy case_ Switch", "if while return"),
    (T.identifier_tokens_legacy, "get_URLName-2 x3y", "get name url xy"),
    (T.call_tokens_legacy, "obj->my_call", "mycall"),
    (T.call_tokens_legacy, "std::vector.Push_Back", "pushback"),
    (T.call_tokens_legacy, "a b", ""),
    (T.raw_tokens_legacy, "fooBar(a.b, c=\"d\")", "a b bar c d foo"),
    (T.control_tokens_legacy, "if (!a && b || c\\t)", "a b c if"),
])
def test_known_tokens(spark, expression, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("got")).first().got
    ordered = expression not in (T.identifier_tokens_legacy, T.raw_tokens_legacy, T.control_tokens_legacy)
    assert " ".join(got if ordered else sorted(got)) == expected


@pytest.mark.parametrize("expression", [T.identifier_tokens_legacy, T.call_tokens_legacy, T.raw_tokens_legacy, T.control_tokens_legacy])
def test_token_sets_are_sets(strings, expression):
    for text, got in values(strings, expression):
        assert len(got) == len(set(got)) and all(g == g.lower() for g in got), repr(text)


def test_long_literal_and_long_word(spark):
    long = '"' + "x\\\"" * 40_000 + '" foo(' + "Ab" * 60_000 + ")"
    row = spark.createDataFrame([(long,)], "t string").select(
        F.size(T.code_tokens("t")).alias("n"), F.array_join(E.calls(F.col("t")), " ").alias("c")
    ).first()
    # placeholders know no escapes, so every second x stands between two of them
    assert row.n == 20_001 + 20_000 + 1 + 60_000 and row.c == "foo"


def test_cleaning_and_paths(spark):
    frame = spark.createDataFrame([("\xa0a\r\nb\rc \n ", "c", ["a", "b", "c", "d"], ["a"])], "t string, ext string, tokens array<string>, one array<string>")
    got = frame.select(
        T.minimal_clean_text("t").alias("clean"), T.safe_project_name(F.lit("__a b/c__")).alias("name"),
        T.safe_project_name(F.lit("//")).alias("none"), T.ensure_c_source(F.lit("#include <x>")).alias("body"),
        T.source_key(F.lit("/r/p/1.cpp")).alias("key"), T.dotted_extension("ext").alias("ext"),
        F.array_join(T.ngrams("tokens", 3), "|").alias("tri"), F.size(T.ngrams("one", 2)).alias("short"),
        F.size(T.ngrams("one", 3)).alias("shorter"),
    ).first()
    assert got.clean == "a\nb\nc" and got.name == "a_b_c" and got.none == "unknown_project"
    assert got.body == "#include <x>\n" and got.key == "p/1.cpp" and got.ext == ".c"
    assert got.tri == "a b c|b c d" and got.short == 0 and got.shorter == 0


def test_cells(spark):
    text = "int aB(char *p) { if (p) return go_1(p); }" * 2
    frame = spark.createDataFrame([(text,), ("x",)], "text string")
    got = frame.select(E.pseudo_cell("text").alias("cpg")).withColumn("nodes", E.parse_cell("cpg")).collect()
    kinds = [n["_label"] for n in got[0].nodes]
    assert kinds.count("CONTROL_STRUCTURE") == 2 and kinds.count("CALL") == 6  # aB, if, go_1, twice
    assert got[1].cpg.endswith("--====--") and got[1].nodes == []  # too short to be parsed
    odd = spark.createDataFrame([('CALL', 'a"b', 'x\ny')], "l string, n string, c string")
    import json

    assert json.loads(odd.select(E.node_json(F.col("l"), F.col("n"), F.col("c")).alias("j")).first().j) == {
        "_label": "CALL", "name": 'a"b', "code": "x\ny",
    }


def test_patterns_reject_early_and_find_the_same(spark):
    """The patterns as they stood before cheap tests were put first, on every short string of the characters that they tell apart."""
    from itertools import product

    from tagloom.functions import elements as E
    from tagloom.functions import text as X

    upper, words = X._UPPER_PIECE, "|".join(E.CONTROL_WORDS)
    before = {
        f"{upper}|{X._LOWER_PIECE}": f"{upper}|(?<![A-Za-z0-9])(?![0-9]++(?![A-Za-z0-9]))[a-z0-9]++",
        X._COMMENT_OR_LITERAL: r"(?smd)//.*?$|/\*.*?\*/|(" + X._LITERAL + ")",
        E._IDENTIFIER_PIECE: E._IDENTIFIER_PIECE.replace("(?=[A-Za-z0-9])(?:", "(?:", 1),
        E._CALL: rf"(?<![{X.WORD_CLASS}])([A-Za-z_][A-Za-z0-9_]*+)[{X.SPACE_CLASS}]*+\(",
        E._CONTROL: rf"(?<![{X.WORD_CLASS}])({words})(?![{X.WORD_CLASS}])",
    }
    assert all(new != old for new, old in before.items())
    texts = ["".join(p) for n in range(1, 6) for p in product("aB1_ é", repeat=n)]
    texts += ["".join(p) for n in range(1, 5) for p in product(("/", "*", "'", '"', "\\", "\n", "a"), repeat=n)]
    texts += ["".join(p) for n in range(1, 5) for p in product(("if", "switch", "(", " ", "　", "é", "_", "9"), repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for new, old in before.items():
        found = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (new, old)]
        assert rows.where(found[0] != found[1]).count() == 0, new

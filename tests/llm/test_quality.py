"""Line figures against a plain reading of the rules."""

import random
import re
from collections import Counter

from growthlens.llm import quality
from tests.llm.conftest import words

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, cover = Counter(runs), set()
    for i, r in enumerate(runs):
        if count[r] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed


def test_figures(spark):
    rng = random.Random(4)
    texts = ["", None, "\n", "a\n", " x\n x\n x", "a b\n\na b\n", "# * $ %&|<> é", "a a a a a a a a a a a a"]
    for _ in range(60):
        lines = [words(rng, rng.randrange(0, 9), 4) for _ in range(rng.randrange(0, 9))]
        texts.append(rng.choice(["\n", "\n\n", " \n"]).join(lines) + rng.choice(["", "\n", "\t"]))
    rows = list(enumerate(texts))
    for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]]), repr(texts[r["doc_id"]])


def test_lines_and_verdict(spark):
    good = "The harbour was quiet that morning, and nobody had come to see the boats leave."
    other = "Later the market filled with people who sold fish, bread, flowers and old books."
    rows = [
        (1, f"{good}\nHome | About | Contact | Login\n{other}\nAll Rights Reserved."),
        (2, "Home | Menu\nclick here to win things today with us now\n" + "we use COOKIE policy\nuses cookies on every page that you may visit here\n" + good[:30]),
        (3, good),
    ]
    out = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["clean_text"] == f"{good}\n{other}\n" and out[1]["kept"]
    assert not out[2]["kept"] and out[2]["n_lines_dropped"] >= 3
    assert out[3]["kept"] and out[3]["clean_text"] == good


def test_closing_marks_of_many_scripts(spark):
    """A short line needs a closing mark; a letter of another script is none."""
    closed = ["Fin.", "\u00bfQu\u00e9?", "\u7d42\u308f\u308a\u3002", "dit \u00aboui\u00bb", "\u0645\u0627\u0630\u0627\u061f", "\u201eja\u201c", "\u0938\u092e\u093e\u092a\u094d\u0924\u0964"]
    open_ = ["Caf\u00e9", "\u0421\u043f\u043e\u0440\u0442 \u041d\u043e\u0432\u043e\u0441\u0442\u0438", "\u65e5\u672c\u8a9e", "\u0391\u03b8\u03ae\u03bd\u03b1", "Home page", "wow ***", "50%", "\U0001f600", "\u00ab", "a\u0300"]
    rows = list(enumerate([*closed, *open_]))
    got = {r["doc_id"]: r["n_lines_dropped"] for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [0] * len(closed) + [1] * len(open_)

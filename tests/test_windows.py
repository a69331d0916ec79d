"""Windows of edits in long texts: the same window, in a time that a text of 20,000 words allows."""
import random
import time

from lectern.functions.similarity import best_window


def test_a_long_text_is_searched_in_time():
    rng = random.Random(3)
    hay = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)]
    needle = [*hay[7_000:7_020], "?", *hay[7_021:7_040]]
    began = time.thread_time()
    assert best_window(needle, hay) == (1, 7_000, 7_040) and time.thread_time() - began < 1


def test_ties_go_as_they_did():
    assert best_window(list("ab"), list("abab")) == (0, 0, 2) and best_window(list("abc"), list("ac")) == (1, 0, 2)
    assert best_window([], list("ab")) == (0, 0, 0) and best_window(list("ab"), []) == (2, 0, 0)

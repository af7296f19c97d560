"""op6 on short templates with one word replaced or left out at each place."""

from test_small import table


def test_one_word_edits_of_lines(spark):
    import re

    from loam.llm.license_scan import TEMPLATES, scan

    rows, want = [], {}
    for name, text in TEMPLATES.items():
        words = re.findall(r"[A-Za-z0-9]+", text)
        if name.endswith("line"):
            for at in range(len(words)):
                for put in (["other"], []):
                    # without this word the one line is the other, whole
                    want[len(rows)] = ("CC-BY-4.0 line" if words[at] == "ShareAlike" else name, len(words) - 1)
                    rows.append((len(rows), " ".join(["before", *words[:at], *put, *words[at + 1 :], "after"])))
    found = {}
    for r in scan(table(spark, rows)).collect():
        found.setdefault(r.doc_id, set()).add((r.license, r.n_matched))
    assert {i: f for i, f in found.items()} == {i: {w} for i, w in want.items()}

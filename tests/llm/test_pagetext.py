import time

import pytest

from ledgerleaf.llm import pagetext

LONG = "The river rises in the hills, runs past the mill, and joins the sea; nobody has measured it. " * 4
#: No tag or class tells what a part is: only the paths' ratios do.
NEUTRAL = (
    "<div><div>"
    + "".join(f"<div><a href='/{k}'>Section {k}</a></div>" for k in range(12))
    + "</div><div><div><div>"
    + "<div>On rivers</div>" + f"<div>{LONG}</div><div>It does, though.</div><div>{LONG}<a href='/x'>source</a> and more.</div><div>{LONG}</div>"
    + "</div></div></div><table><tr>"
    + "".join(f"<td>Tile {k}</td>" for k in range(12))
    + "</tr></table></div>"
)


def test_ratios_decide_on_pages_without_telling_tags(monkeypatch):
    want = " ".join(f"On rivers {LONG}It does, though. {LONG}source and more. {LONG}".split())
    assert pagetext.main_text(NEUTRAL) == want
    monkeypatch.setattr(pagetext, "THRESHOLD", -1)
    everything = pagetext.main_text(NEUTRAL)
    assert "Section 3" in everything and "Tile 3" in everything
    monkeypatch.setattr(pagetext, "THRESHOLD", 50)
    assert pagetext.main_text(NEUTRAL) == ""


def test_threshold_decides_on_the_given_pages(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    found = [pagetext.main_text(p) for p in pages]
    monkeypatch.setattr(pagetext, "THRESHOLD", 0.9)
    assert sum(pagetext.main_text(p) != x for p, x in zip(pages, found)) > len(pages) / 2


def test_values_equal_plain_sums():
    """Ratios of a path, smoothed with weights by edits, times each other."""
    page = pagetext.Page("<body><p>a, b.</p><p>cc</p><ul><li>d<li><a>ee</a></ul><p>" + "f" * 10 + "</p></body>")
    assert [b.text for b in page.blocks] == ["a, b.", "cc", "d", "ee", "f" * 10]
    p, li = page.blocks[0].path, page.blocks[2].path
    assert (page.edits(p, p), page.edits(p, li), page.edits(li, p)) == (0, 2, 2)
    of = {p: (17 / 3, 3 / 3, 1.0), li: (3 / 2, 1 / 2, 1 - 2 / 3)}
    paths, out = [p, p, li, li, p], []
    for k, own in enumerate(paths):
        near = [(2.718281828459045 ** (-0.5 * page.edits(own, x) ** 2), of[x]) for x in paths[max(0, k - 2) : k + 3]]
        total = sum(w for w, _ in near)
        value = of[own][2]
        for x in range(3):
            value *= sum(w * r[x] for w, r in near) / total
        out.append(value)
    mean = sum(out) / len(out)
    assert pagetext.values(page) == pytest.approx([v / mean for v in out])


@pytest.mark.parametrize("part", ["<b>x", '<a "', "<p>x", "<div>x", "<li><b>x", "<a href='", "</i>", "<tr><td>x", "<b><p>x</p>", "<!--", "<script>", "< "])
def test_time_grows_with_the_page(part):
    start = time.process_time()
    pagetext.main_text(part * 10_000)
    small = time.process_time() - start
    start = time.process_time()
    pagetext.main_text(part * 100_000)
    assert time.process_time() - start < max(30 * small, 6)

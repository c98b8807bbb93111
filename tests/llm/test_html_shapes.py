"""Elements that end themselves, and custom elements named like raw ones."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest

from sensorlake.llm import html_extract

FIRST, LAST = "First paragraph of the page, long enough to stay.", "Last paragraph of the page, long enough to stay."


@pytest.mark.parametrize(
    "between",
    [
        '<svg class="i"/>', "<svg/>", "<math />", "<svg a='x>y' hidden/>", "<SVG class=i />",
        "<video-player src=x></video-player>", "<select-menu></select-menu>", "<title-bar></title-bar>", "<svg-icon/>",
        '<svg><path d="M0"/><g/></svg>', "<svg><title>no</title></svg>", "<select><option>no</select>", "<svg href=x/>no</svg>",
        "<video\nsrc=x>no</video>", "<script>var a = '<svg/>';</script>",
    ],
)
def test_the_rest_of_the_page_stays(between):
    page = f"<body><article><p>{FIRST}</p>{between}<p>{LAST}</p></article></body>"
    assert html_extract.main_text(page) == f"{FIRST}\n{LAST}"
    page = f"<body><article><p>{FIRST}</p>{between}<p>{LAST}</p><svg><path/></svg></article></body>"
    assert html_extract.main_text(page) == f"{FIRST}\n{LAST}"


@pytest.mark.parametrize("open_tag", ["<select>", "<object data=x>", "<video src=x>", "<svg>", "<canvas>", "<template>", "<noscript>", "<iframe src=x>"])
def test_an_element_without_end_swallows_nothing(open_tag):
    name = open_tag[1:].split()[0].rstrip(">")
    page = f"<body><article><p>{FIRST}</p>{open_tag}<p>{LAST}</p></article></body>"
    assert html_extract.main_text(page) == f"{FIRST}\n{LAST}"
    page = f"<body><article><p>{FIRST}</p>{open_tag}<p>{LAST}</p><{name}><b>no</b></{name}></article></body>"
    assert html_extract.main_text(page) == f"{FIRST}\n{LAST}"
    page = f"<body><article><p>{FIRST}</p><{name}><{name}>no</{name}><p>Nor this text inside, long as it is.</p></{name}><p>{LAST}</p></article></body>"
    assert html_extract.main_text(page) == f"{FIRST}\n{LAST}"


def _time(page: str) -> float:
    begun = time.process_time()
    html_extract.main_text(page)
    return time.process_time() - begun


@pytest.mark.parametrize(
    "piece",
    [
        f'<p>{FIRST}</p><div class="advert"><a href="x">Buy now</a></div>',
        f"<div>{FIRST}",
        "<a href='x>open quote</a>",
        '<a href="x>open quote</a>',
        "</span></section></li>" + f"<p>{FIRST}</p>",
        f"<select><option>no<p>{FIRST}</p>",
    ],
)
def test_time_grows_with_the_page(piece):
    html_extract.main_text(piece * 100)
    short, long = (min(_time(f"<body><article>{piece * n}</article></body>") for _ in range(2)) for n in (1000, 8000))
    assert long < 24 * max(short, 0.02)


def test_labels_are_the_cheapest_of_all():
    """The labelling of small pages against every other labelling of their blocks' nodes."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        source, sink = rng.random(n).round(3) * 3, rng.random(n).round(3) * 3
        edges = [(k - 1, k, float(rng.random())) for k in range(1, n)]
        edges += [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, n, (3, 2)) if a != b]

        def cost(kept):
            cut = sum(sink[k] if kept[k] else source[k] for k in range(n))
            return cut + sum(c for a, b, c in edges if kept[a] != kept[b])

        got = html_extract.min_cut(n, source.tolist(), sink.tolist(), edges)
        assert cost(got) == pytest.approx(min(cost(kept) for kept in itertools.product([False, True], repeat=n)))

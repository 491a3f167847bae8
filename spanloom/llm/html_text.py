"""Main text of web pages: a linear-chain conditional random field over the page's leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import html_pages
from .common import map_texts

#: Elements whose content is raw text and none of the page; the first two go on to the end of a page that doesn't close them.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")}
ENDLESS = frozenset(("script", "style"))
#: Elements whose content isn't shown, as far as they reach; the second set belongs to form controls and ends at other blocks.
HIDDEN = frozenset("svg canvas template title textarea iframe xmp noembed noframes select option optgroup datalist".split())
CONTROL = frozenset("select option optgroup datalist title textarea iframe xmp noembed noframes".split())
#: Elements of a page that end a drawing they stand in.
BREAKS = frozenset("address article aside blockquote body div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
MARKS = re.compile(r"[>\"']")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+")
CUE = re.compile(r"[^\W\d_]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these, up to the nearest of the second set.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {tag: (a.split(), b.split()) for tag, (a, b) in ENDS.items()}
#: Elements that say what their content is for; others do if they have a class, id or role.
SPEAKING = frozenset("article aside dialog fieldset footer form header main menu nav".split())
#: Features of ancestors' names that a block has at most, and paths that are remembered between pages.
MOST_NAMES, MOST_NODES = 512, 50_000


class Node:
    """An element of a path: its tag, name tokens and parent. Equal paths are one node, so features are made once."""

    __slots__ = ("children", "features", "found", "hidden", "names", "parent", "tag", "under")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.hidden = parent is not None and (parent.hidden or tag in HIDDEN)
        self.children: dict = {}
        self.found: frozenset[str] | None = None if parent else frozenset()
        self.features: tuple[str, ...] | None = None
        #: The nearest element from here up that says what its content is for, the root if none does.
        self.under: Node = self if parent is None or names or tag in SPEAKING else parent.under

    def child(self, tag: str, names: tuple[str, ...]) -> Node:
        node = self.children.get((tag, names))
        if node is None:
            node = self.children[tag, names] = Node(tag, names, self)
        return node


class Tree:
    """The paths that were met."""

    def __init__(self):
        self.root, self.size = Node("", (), None), 0

    def start(self) -> Node:
        if self.size > MOST_NODES:
            self.__init__()
        return self.root


class Block:
    """A leaf block: its text, its element, and characters inside links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: Node, linked: int):
        self.text, self.path, self.linked = text, path, linked


def _after_equals(source: str, at: int) -> bool:
    """Whether a quote here begins an attribute's value."""
    at -= 1
    while source[at].isspace():
        at -= 1
    return source[at] == "="


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Each tag's first place, the place after it, whether it closes, its lower-case name, its attributes as they stand.
    What isn't text between is inside these: a comment or declaration has the name "", raw text belongs to its tag. One
    pass: a search that runs to the end in vain isn't made again."""
    at, size, quotes = 0, len(source), True
    last = source.rfind(">")
    unclosed: set[str] = set()
    while 0 <= (at := source.find("<", at)) < last:
        if source.startswith(("<!", "<?"), at):
            comment = source.startswith("<!--", at)
            end = source.find("-->" if comment else ">", at + 2)
            end = size if end < 0 else end + (3 if comment else 1)
            yield at, end, False, "", ""
            at = end
            continue
        closing = source.startswith("</", at)
        named = NAME.match(source, at + 1 + closing)
        if not named:
            at += 1
            continue
        tag, end = named[0].lower(), named.end()
        while quotes:
            mark = MARKS.search(source, end)
            if mark is None:
                quotes = False
            elif mark[0] == ">":
                end = mark.start()
                break
            elif not _after_equals(source, mark.start()):
                end = mark.end()
            else:
                after = source.find(mark[0], mark.end())
                if after < 0 or after > last:
                    quotes = False  # a quote that isn't closed is a mark like any other, from here on
                else:
                    end = after + 1
        else:
            end = source.find(">", named.end())
        own = source[named.end() : end]
        after = end + 1
        if tag in RAW and not closing and not own.endswith("/"):
            found = None if tag in unclosed else RAW[tag].search(source, after)
            if found:
                after = source.find(">", found.end())
                after = size if after < 0 else after + 1
                tag = ""
            elif tag in ENDLESS:
                after, tag = size, ""
            else:
                unclosed.add(tag)
        yield at, after, closing, tag, own
        at = after


_tree = Tree()


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with text in page order. Inline elements don't part a block and <br> is white space; an unclosed
    paragraph ends at the next block; a closing tag without its element is passed over. Takes time in proportion to the
    page, whatever its nesting."""
    source = page or ""
    out: list[Block] = []
    path = _tree.start()
    stack: list[Node] = []
    places: dict[str, list[int]] = {}
    held: list[str] = []
    links, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = "" if path.hidden else " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, path, linked))
            held.clear()
        linked = 0

    def cut(n: int) -> None:
        """Ends the open elements from the n-th on."""
        while len(stack) > n:
            places[stack.pop().tag].pop()

    def innermost(names: Iterable[str]) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=-1)

    for start, end, closing, tag, own in tags(source):
        if start > at:
            held.append(source[at:start])
            if links:
                linked += start - at
        at = end
        if not tag:
            held.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            held.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in VOID or (not closing and own.endswith("/") and (tag in HIDDEN or tag in RAW or places.get("svg"))):
            continue
        if closing:
            n = innermost((tag,))
            if n >= 0:
                cut(n)
        else:
            if tag not in CONTROL and (n := min((places[t][0] for t in CONTROL if places.get(t)), default=-1)) >= 0:
                cut(n)
            if tag in BREAKS and places.get("svg"):
                cut(places["svg"][0])
            if stack and stack[-1].tag == "p":
                cut(len(stack) - 1)
            elif tag in ENDS:
                ended, until = ENDS[tag]
                barrier = innermost(until)
                n = min((i for t in ended for i in places.get(t, ())[-1:] if i > barrier), default=-1)
                if n >= 0:
                    cut(n)
            names = tuple(sorted({t for n in NAMED.findall(own) for t in TOKEN.findall("".join(n).lower())})) if own else ()
            links = 0
            above = stack[-1] if stack else _tree.root
            places.setdefault(tag, []).append(len(stack))
            stack.append(above.child(tag, names))
            _tree.size += 1
        path = stack[-1] if stack else _tree.root
    if at < len(source):
        held.append(source[at:])
        linked += (len(source) - at) * links
    flush()
    return out


def _found(node: Node) -> frozenset[str]:
    """Features of the tags and names of all ancestors."""
    line = []
    while node.found is None:
        line.append(node)
        node = node.parent
    for below in reversed(line):
        own = {f"in={below.tag}", *(f"name={n}" for n in below.names)}
        own.update(f"stem={stem}" for n in below.names for stem in html_pages.STEMS if n.startswith(stem))
        below.found = node.found if own <= node.found or len(node.found) >= MOST_NAMES else node.found | own
        node = below
    return node.found


def _path_features(node: Node) -> tuple[str, ...]:
    if node.features is None:
        found, up = set(_found(node)), node
        for k in range(3):
            if up.parent is None:
                break
            found.add(f"up{k}={up.tag}")
            found.update(f"up{k}name={n}" for n in up.names)
            up = up.parent
        found.add(f"under={node.under.tag or 'none'}")
        found.update(f"undername={n}" for n in node.under.names)
        node.features = tuple(sorted(found or {"in=none"}))
    return node.features


def features(block: Block) -> tuple[str, ...]:
    """Of the ancestors' tags and names, and of the text: length, links, end mark, capitals, few words' identity."""
    text = block.text
    n = len(text)
    found = [*_path_features(block.path), f"long={min(n, 1023).bit_length()}", f"links={min(3, 4 * block.linked // (n + 1))}", "end" if text[-1] in ".!?:;\"'”»…)" else "no end"]
    if text.count(".") + text.count(",") >= 3:
        found.append("sentences")
    if not block.path.under.tag:
        found.extend(("silent " + found[-1], f"silent long={min(n, 1023).bit_length()}"))
    if "©" in text or "|" in text:
        found.append("marks")
    if n < 120:
        found.extend(f"word={w}" for w in {w.lower() for w in CUE.findall(text)} if w in html_pages.CUES)
    return tuple(found)


class Chain:
    """Two states, 1 for main text. weights: of each feature, for state 1 against state 0; step: 2 x 2; first: 2."""

    def __init__(self, weights: dict[str, float], step: np.ndarray, first: np.ndarray):
        self.weights, self.step, self.first = weights, step.tolist(), first.tolist()

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely states; ties go to state 0."""
        if not blocks:
            return []
        get = self.weights.get
        (s00, s01), (s10, s11) = self.step
        back, zero, one = [], self.first[0], self.first[1] + sum(get(f, 0.0) for f in features(blocks[0]))
        for b in blocks[1:]:
            from0, from1 = zero + s00 >= one + s10, zero + s01 >= one + s11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            zero, one = max(zero + s00, one + s10), max(zero + s01, one + s11) + sum(get(f, 0.0) for f in features(b))
        state = int(one > zero)
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return [bool(s) for s in reversed(states)]


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], steps: int = 150, rate: float = 0.2, shrink: float = 2e-5) -> Chain:
    """Maximum likelihood by Adam: pages of (features of each block, its state), gradients by forward-backward."""
    names = sorted({f for feats, _ in pages for fs in feats for f in fs})
    number = {f: i for i, f in enumerate(names)}
    n, length = len(pages), max(len(s) for _, s in pages)
    flat = [(p, t, number[f]) for p, (feats, _) in enumerate(pages) for t, fs in enumerate(feats) for f in fs]
    rows, cols, which = (np.array(x) for x in zip(*flat, strict=True))
    cell = rows * length + cols
    here = np.zeros((n, length), bool)
    gold = np.zeros((n, length), np.int64)
    for p, (_, states) in enumerate(pages):
        here[p, : len(states)] = True
        gold[p, : len(states)] = states
    blocks = here.sum()
    at = np.zeros(len(names) + 6)
    mean, spread = np.zeros_like(at), np.zeros_like(at)
    add = np.logaddexp
    for k in range(1, steps + 1):
        step, first = at[-6:-2].reshape(2, 2), at[-2:]
        emit = np.zeros((n, length, 2))
        emit[:, :, 1] = np.bincount(cell, at[which], n * length).reshape(n, length)
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = first + emit[:, 0]
        for t in range(1, length):
            go = alpha[:, t - 1, :, None] + step + emit[:, t, None, :]
            alpha[:, t] = np.where(here[:, t, None], add(go[:, 0], go[:, 1]), alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            go = step + emit[:, t + 1, None, :] + beta[:, t + 1, None, :]
            beta[:, t] = np.where(here[:, t + 1, None], add(go[:, :, 0], go[:, :, 1]), 0)
        total = add(alpha[:, -1, 0], alpha[:, -1, 1])
        odds = np.exp(alpha + beta - total[:, None, None]) * here[:, :, None]
        slope = np.zeros_like(at)
        off = np.where(here, odds[:, :, 1] - gold, 0)
        slope[:-6] = np.bincount(which, off.ravel()[cell], len(names))
        pair = here[:, 1:]
        joint = alpha[:, :-1, :, None] + step + emit[:, 1:, None, :] + beta[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * pair[:, :, None, None]).sum(axis=(0, 1))
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
        slope[-6:-2] = (expected - seen).ravel()
        slope[-2:] = odds[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=2)
        slope = slope / blocks + shrink * at
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        at -= rate * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.999**k)) + 1e-9)
    return Chain({f: float(w) for f, w in zip(names, at, strict=False) if abs(w) > 1e-9}, at[-6:-2].reshape(2, 2), at[-2:])


@lru_cache(maxsize=1)
def model() -> Chain:
    """Trained on html_pages.PAGES generated pages whose blocks carry their labels."""
    pages = []
    for page, wanted in html_pages.labelled_pages():
        blocks, left = leaf_blocks(page), list(wanted)
        states = []
        for b in blocks:
            text, state = left.pop(0)
            if text != b.text:
                raise ValueError(f"the page's block is {b.text!r}, its label's {text!r}")
            states.append(state)
        pages.append(([features(b) for b in blocks], states))
    return train(pages)


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, main in zip(blocks, chain.decode(blocks), strict=True) if main)


def extract(pages: DataFrame, page: str = "html", to: str = "text") -> DataFrame:
    """pages with column `to`, the main text of the whole html, "" if it has none or is null or empty. Other columns pass
    through; a column of the name `to` is replaced. No shuffle. The model is trained on the driver, once a process."""
    shared = pages.sparkSession.sparkContext.broadcast(model())
    fields = [f for f in pages.schema.fields if f.name != to]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = pa.array([main_text(p.as_py(), shared.value) for p in batch.column(page)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), found], names=[*(f.name for f in fields), to])

    return map_texts(pages, batches, T.StructType([*fields, T.StructField(to, T.StringType())]))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages. Null, empty and textless html give "" and 0; rows that
    repeat each give a row; null ids and urls stay null. Other columns are not read; an empty table gives no rows."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))

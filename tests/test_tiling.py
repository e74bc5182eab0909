"""Fast tiling against the literal rounds, and the fixtures' numbers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import lexer, tiling
from tessella.functions.tiling import Side


def rounds(left, right, lm, rm, least):
    """Greedy string tiling as it is defined: look through all pairs, take the longest, start again."""
    lm, rm, out = list(lm), list(rm), []
    while True:
        found = []
        for i in range(len(left)):
            for j in range(len(right)):
                n = 0
                while i + n < len(left) and j + n < len(right) and left[i + n] == right[j + n] and not lm[i + n] and not rm[j + n]:
                    n += 1
                if n >= least:
                    found.append((n, i, j))
        if not found:
            return out
        top = max(found)[0]
        for n, i, j in sorted(x for x in found if x[0] == top):
            if not any(lm[i : i + n]) and not any(rm[j : j + n]):
                lm[i : i + n] = rm[j : j + n] = [True] * n
                out.append((i, j, n))


side = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 9).map(lambda x: x == 0)), max_size=24)


@settings(max_examples=400, deadline=None)
@given(side, side, st.integers(1, 4))
def test_greedy_equals_rounds(left, right, least):
    (l, lm), (r, rm) = (([t for t, _ in x], [m for _, m in x]) for x in (left, right))
    assert tiling.greedy_tiles(tiling.Grams(l, lm, least), tiling.Grams(r, rm, least)) == rounds(l, r, lm, rm, least)


def plain(n):
    return Side([f"T{i}" for i in range(n)], list(range(n)), [False] * n)


def find(tiles, left, right):
    return tiling.regions(tiles, plain(left), plain(right))


@pytest.mark.parametrize("sizes, want", [((20, 50), 10), ((400, 600), 12), ((2000, 3000), 15)])
def test_threshold(sizes, want):
    assert tiling.threshold(*sizes) == want


def test_regions():
    assert [r.exact for r in find([(0, 0, 9), (12, 10, 10)], 40, 40)] == [10]
    (r,) = find([(0, 0, 6), (8, 8, 6)], 40, 40)
    assert (r.left_end, r.right_end, r.exact, r.effective, r.anchor) == (13, 13, 12, 14, 6)
    assert find([(0, 0, 6), (10, 10, 6)], 40, 40) == find([(0, 0, 6), (8, 13, 6)], 40, 40) == []
    assert [(r.left_end, r.exact, r.effective) for r in find([(0, 0, 6), (8, 8, 6), (16, 16, 6)], 80, 80)] == [(21, 18, 22)]
    assert [(r.left_end, r.exact) for r in find([(0, 0, 10), (12, 12, 6)], 40, 40)] == [(9, 10)]
    assert [(r.left_end, r.exact, r.effective) for r in find([(k, k, 6) for k in (0, 8, 16, 24)], 40, 40)] == [(29, 24, 30)]
    hidden = Side(plain(20).tokens, [*range(6), *range(10, 24)], [False] * 20)
    assert tiling.regions([(0, 0, 6), (6, 6, 6)], hidden, hidden) == []  # four units are left out between them
    assert tiling.split_on_gaps([(0, 0, 12)], hidden.units, list(range(20))) == [(0, 0, 6), (6, 6, 6)]


@pytest.mark.parametrize(
    "tiles, left, right, least, want",
    [
        ([(2, 3, 10)], 20, 20, 8, 0.451171875),
        ([(0, 0, 6), (8, 8, 6)], 40, 40, 6, 0.2839082303890348),
        ([(0, 0, 40)], 80, 400, 8, 0.17637915695155737),
        ([(0, 0, 40)], 400, 400, 8, 0.0955),
        ([(0, 0, 25)], 1000, 1000, 8, 0.02378125),
        ([(0, 0, 16), (30, 30, 8)], 120, 120, 8, 0.12755555555555556),
        ([(0, 0, 9)], 20, 20, 8, 0.0),
    ],
)
def test_scores(tiles, left, right, least, want):
    assert tiling.score(find(tiles, left, right), left, right, least) == pytest.approx(want, abs=1e-9)


def norms(source, language, boundaries=()):
    return [t.norm for t in lexer.lex(source, language, boundaries).tokens]


def test_lexers():
    got = norms('class A { String s = "menu"; char c = \'x\'; int n = 0x1F; boolean b = true; List<Item> l = new Box(); }', "java")
    assert {"STR", "CHAR", "ID", "TYPE_ID", "NUM", "BOOL"} <= set(got) and "menu" not in "".join(got)
    assert norms('char *s = "menu" " text"; char c = \'x\';', "c").count("STR_LIT") == 1
    assert norms('auto s = R"(a " b)"; char c = \'x\';', "cpp").count("STR_LIT") == 1
    assert {"ID", "TYPE_ID", "FIELD_ID"} <= set(norms("struct Item { int count; }; int f(struct Item *p) { return p->count + 0xE; }", "c"))
    assert "FLOAT_LIT" in norms("x = 0xE;", "c")
    assert {"ID", "TYPE_ID", "FIELD_ID", "NS_ID"} <= set(norms("namespace demo { struct Item { int n; }; } int f(demo::Item i) { return i.n; }", "cpp"))
    java = lexer.lex("package a.b; import c.d; class A {} ", "java")
    assert [t.norm for t in java.tokens][:2] == ["class", "ID"] and java.tokens[0].unit_index >= 2
    assert norms("#include <stdio.h>\n#ifdef X\nint a; // gone\n#endif\n", "c") == []
    two = lexer.lex("int a;\nint b;\n", "c", (7,)).tokens
    assert two[3].unit_index == two[2].unit_index + 2
    assert len(lexer.lex("// one\nint a; /* two */", "c").comments) == 2


def test_trailing_comments():
    source = "int a; // x\n// own line\nint b; /* y\nz */ int c;\nchar *s = \"// no\"; char q = '\"'; // é\n"
    data = source.encode()
    assert [data[a:b].decode() for a, b in lexer.trailing_comments(source)] == ["// x\n", "/* y\nz */", "// é\n"]


def test_comment_words():
    assert lexer.normalize_comment("/* Find THE top-student: élève! */") == "find the top student élève"

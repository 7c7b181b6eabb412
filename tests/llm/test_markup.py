import pytest

from tidelog.llm import markup as m


def words(text):
    return [" ".join(m.words(s)) for s in m.streams(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", [""]),
        ("Plain Words, twice.", ["plain words twice"]),
        ("\\newcommand{\\kx}{red fox}The \\kx{} and \\kx\\ jump", ["the red fox and red fox jump"]),
        ("\\def\\kx{red \\ky{}}\\def\\ky{fox}A \\kx.", ["a red fox"]),
        ("one % aside\ntwo", ["one two", "aside"]),
        ("% a passage\n% in two re-\n% marks\nrest", ["rest", "a passage in two remarks"]),
        ("50\\% of it", ["50 of it"]),
        ("be-\n  fore and semi-formal", ["before and semi formal"]),
        ("see~\\cite{a,b} this \\footnote{a \\emph{side} note} here (\\ref{x})", ["see this here", "a side note"]),
        ("\\begin{theorem}Das \\textbf{W}ort\\end{theorem}", ["das wort"]),
        ("\\iffalse hidden words \\fi shown", ["hidden words shown"]),
        ("\\newcommand{\\norm}[1]{\\lVert #1 \\rVert} $\\norm{u}_{2}$", ["u 2"]),
        ("{unbalanced \\emph{x", ["unbalanced x"]),
        ("ärger ÜBER", ["ärger über"]),
    ],
)
def test_streams(text, expected):
    assert words(text) == expected


@pytest.mark.parametrize("depth", [1, 5, 10, 300])
def test_own_commands_of_any_depth(depth):
    name = lambda k: "\\k" + "".join(chr(97 + int(d)) for d in str(k))
    definitions = "".join(f"\\newcommand{{{name(k)}}}{{{name(k + 1)}}}" for k in range(depth)) + f"\\def{name(depth)}{{alpha wording}}"
    assert words(definitions + "the " + name(0) + "{} ends") == ["the alpha wording ends"]


def test_own_commands_that_contain_themselves():
    assert words("\\def\\a{one \\b}\\def\\b{two \\a}\\def\\c{three \\a}say \\c and \\a now") == ["say three and one now"]
    bomb = "".join(f"\\def\\{chr(97 + k)}{{\\{chr(98 + k)}\\{chr(98 + k)}}}" for k in range(24)) + "\\def\\y{lol }"
    assert m.words(m.streams(bomb + "end \\a")[0])[0] == "end"


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 400])
def test_notes_and_braces_of_any_depth(depth):
    note = "\\emph{" * depth + "deep" + "}" * depth
    assert words(f"before \\footnote{{a {note} note}} after") == ["before after", "a deep note"]
    nested = "".join(f"\\footnote{{n{k} " for k in range(depth)) + "".join(f"t{k}}} " for k in reversed(range(depth)))
    assert words(f"before {nested}after") == ["before after", *(f"n{k} t{k}" for k in range(depth))]
    assert m.words(m.prose("one \\title{" + "{" * depth + "no" + "}" * depth + "} two")) == ["one", "two"]


def test_braces_are_paired_alike_near_and_far():
    import random

    rng = random.Random(6)
    for n in (20, 300, 9_000):
        text = "".join(rng.choice(["{", "}", "a", "\\{", "\\\\"]) for _ in range(n)) + "}" * (n // 7)
        close, pairs = m.closer(text), m.braces(text)
        opened = [m_.start() for m_ in m._BRACE.finditer(text) if m_[0] == "{"]
        assert [close(at) for at in opened] == [pairs.get(at) for at in opened]


@pytest.mark.parametrize("n", [10, 400, 5_000])
def test_formulas_of_any_length(n):
    assert m.words(m.prose("this $" + "x + alpha " * (n // 10) + "$ is prose")) == ["this", "is", "prose"]
    assert m.words(m.prose("it costs 5 $ there\n\nand more $ here")) == "it costs 5 there and more here".split()


def test_all_words_of_an_item():
    assert m.wording_of_item("About 50 % of the hens\\footnote{or geese} left~\\cite{x}.") == "about 50 of the hens left or geese".split()


def test_prose():
    text = (
        "\\title{Not This}\\begin{document}\\section{Nor this}Some prose with $x^2$ in it. % no\n\\begin{comment}no\\end{comment}\\[ no \\]\\begin{align*}no\\end{align*}"
        "\\begin{tabular}{l}no\\end{tabular}More\\footnote{no} prose~\\cite{no}.\\iffalse no \\fi\\begin{thebibliography}{9}\\bibitem{a} no\\end{thebibliography}\\end{document}"
    )
    assert m.words(m.prose(text)) == "some prose with in it more prose".split()


def test_a_very_long_text_without_ends():
    assert m.streams("\\footnote{" * 20_000)
    assert m.prose("\\begin{align*}" + "{" * 50_000 + "$" * 50_001) is not None
    assert len(m.words(m.prose("word " * 200_000))) == 200_000

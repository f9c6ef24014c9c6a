import pytest
from pyspark.sql import functions as F

from paperloom.functions import lexer, segments
from paperloom.operators import cleaning
from paperloom.operators.selection import DEFAULT_WHITELIST
from paperloom.sources import files as src


def clean(frame, name, text, **options):
    files = frame("project string, path string, content string", ("p", name, text))
    return cleaning.clean_files(files, options.pop("keep_words", DEFAULT_WHITELIST), **options).collect()[0]


CODE_CASES = [
    ("const a = 1; // line\n/* block */\nconst b = 2;", "const a = 1; \n\nconst b = 2;"),
    ('const url = "https://example.com"; // real', 'const url = "https://example.com"; '),
    ("const t = `a // not comment ${x}`; // real", "const t = `a // not comment ${x}`; "),
    ("const re = /\\/\\* not \\*\\//g; // real", "const re = /\\/\\* not \\*\\//g; "),
    ("/** keep me */\nfunction f() {} // remove", "/** keep me */\nfunction f() {} "),
    ("// @ts-ignore\nconst x: any = 1; // remove", "// @ts-ignore\nconst x: any = 1; "),
    ("//! keep this\n// remove this", "//! keep this\n"),
    ("const x = a/*c*/b;", "const x = a b;"),
    ("const x = 1;", "const x = 1;"),
    ("", ""),
    # division is no regex literal, and neither is a slash in a class
    ("a = b / c; // d / e", "a = b / c; "),
    ("x = s.split(/[/\"']/); // q", "x = s.split(/[/\"']/); "),
    ("if (/a\\//.test(s)) {} // q", "if (/a\\//.test(s)) {} "),
    ("return /'/ ; // q", "return /'/ ; "),
    # quotes with escapes, quotes inside comments, adjoining comments
    ("s = 'it\\'s // no'; // yes", "s = 'it\\'s // no'; "),
    ("// don't\nx = 1; // can't", "\nx = 1; "),
    ("a/*x*//*y*/b", "ab"),
    ("$/*x*/_", "$ _"),
    ("é/*x*/b", "éb"),
    # a directive word anywhere keeps a comment
    ("// masTODOn\n// FixMe", "// masTODOn\n// FixMe"),
    ("/* a\r\n b */x // y\r\nz", "x \r\nz"),
    ("/* unclosed", "/* unclosed"),
]


def test_code(frame):
    files = frame("project string, path string, content string", *[(str(i), "stdin.ts", t) for i, (t, _) in enumerate(CODE_CASES)])
    cleaned = cleaning.clean_files(files, DEFAULT_WHITELIST).collect()
    assert {r["project"]: r["content"] for r in cleaned} == {str(i): want for i, (_, want) in enumerate(CODE_CASES)}


NESTED_CASES = [
    ("<a>see http://h/x now</a>;", True, "<a>see http://h/x now</a>;"),
    ("const x = <p>it's // fine</p>; // gone\ny", True, "const x = <p>it's // fine</p>; \ny"),
    ("`a ${b /* c */} // t ${`n ${q // z\n}`}` // e", False, "`a ${b } // t ${`n ${q \n}`}` "),
    ("const a = <div>{/* x */}{y /* z */}</div>;", True, "const a = <div>{y }</div>;"),
    ("const a = <div>{/* x */ /* y */\n}</div>;", True, "const a = <div></div>;"),
    ("const a = <div>{/* TODO x */}</div>;", True, "const a = <div>{/* TODO x */}</div>;"),
    ("<A b={1 /* c */} /* d */ t='//x'>t // x <B/> {f(`${x}`)}</A> // y", True, "<A b={1 }  t='//x'>t // x <B/> {f(`${x}`)}</A> "),
    ("const g = <T,>(x: T) => x; // c", True, "const g = <T,>(x: T) => x; "),
    ("const g = <T extends U>(x: T) => x; // it's", True, "const g = <T extends U>(x: T) => x; "),
    ("if (a < b) {} // c\nconst z = c ? <></> : <i>'</i>; /* d */", True, "if (a < b) {} \nconst z = c ? <></> : <i>'</i>; "),
    ("const x = <Foo<string> a={1}>'//'</Foo>; // c", True, "const x = <Foo<string> a={1}>'//'</Foo>; "),
    ("#!/usr/bin/env node // x\n// y ${", False, "#!/usr/bin/env node // x\n"),
    ("x = <a>unclosed // c", True, "x = <a>unclosed "),
    ("`unclosed ${ a // c\n", False, "`unclosed ${ a \n"),
    ("a = `${{ b: { c: 1 /* d */ } }}` /* e */", False, "a = `${{ b: { c: 1  } }}` "),
]


def test_nested_code(frame):
    files = frame("project string, path string, content string", *[(str(i), "s.tsx" if tags else "s.ts", t) for i, (t, tags, _) in enumerate(NESTED_CASES)])
    cleaned = cleaning.clean_files(files, DEFAULT_WHITELIST).collect()
    assert {r["project"]: r["content"] for r in cleaned} == {str(i): want for i, (_, _, want) in enumerate(NESTED_CASES)}


@pytest.mark.parametrize("text, want", [c for c in CODE_CASES if "TODO" not in c[0].upper() and "keep" not in c[0] and "ts-ignore" not in c[0]])
def test_the_lexer_agrees_with_the_flat_pattern(text, want):
    pieces = lexer.cut(text, False)
    assert "".join(pieces) == text
    assert "".join(pieces[::2]).replace(" ", "") == want.replace(" ", "")


def test_only_texts_that_nest_reach_the_lexer(frame):
    texts = frame("t string, j boolean", ("a // b", False), ("`${a}`", False), ("`${a}` // b", False), ("<a>b // c</a>", True), ("<a>b // c</a>", False))
    assert [r[0] for r in texts.select(lexer.nests(F.col("t"), F.col("j"))).collect()] == [False, False, True, True, False]


def test_deep_nesting_takes_one_pass(frame):
    text = "`${" * 20_000 + "a /* b */" + "}`" * 20_000 + " // c"
    assert lexer.cut(text, False)[1::2] == ["/* b */", "// c"]
    assert len(lexer.cut("x = <a>" + "<b>{/* c */}</b>" * 20_000 + "</a>", True)) == 40_001


def test_doc_blocks_go_on_request(frame):
    assert clean(frame, "stdin.ts", "/** doc */\nconst x = 1;", keep_doc=False)["content"] == "\nconst x = 1;"


def test_expression_containers(frame):
    assert clean(frame, "App.tsx", "const a = <div>{/* x */}</div>;")["content"] == "const a = <div></div>;"
    assert clean(frame, "App.tsx", "const a = <div>{x /* c */}</div>;")["content"] == "const a = <div>{x }</div>;"
    assert clean(frame, "App.tsx", "const f = () => {/* x */};")["content"] == "const f = () => {};"
    assert clean(frame, "a.ts", "<T>{/* x */}<U>")["content"] == "<T>{}<U>"


def test_markup(frame):
    assert clean(frame, "page.html", "<!-- c -->\n<div>x</div>")["content"] == "\n<div>x</div>"
    assert clean(frame, "page.HTM", "a<!-- x\ny -->b // c")["content"] == "a b // c"
    assert clean(frame, "page.html", "<!-- TODO -->")["removed"] == 0
    assert clean(frame, "page.html", "// no /* no */")["content"] == "// no /* no */"


def test_no_comment_leaves_the_text(frame):
    row = clean(frame, "stdin.ts", "const x = 1;")
    assert (row["removed"], row["matches"], row["content"]) == (0, [], "const x = 1;")


def test_text_that_holds_the_cut_mark(frame):
    text = "a = '￿'; // x ￿\nb/*y*/c"
    assert clean(frame, "a.ts", text)["content"] == "a = '￿'; \nb c"


def test_own_words_extend_the_list_per_project(frame):
    files = frame(
        "project string, path string, content string, words array<string>",
        ("p", "a.ts", "// Legal\n// x", ["LEGAL"]),
        ("q", "a.ts", "// Legal\n// x", []),
    )
    rows = {r["project"]: r["content"] for r in cleaning.clean_files(files, F.col("words")).collect()}
    assert rows == {"p": "// Legal\n", "q": "\n"}


def test_long_strings_do_not_exhaust_the_stack(frame):
    text = "x = '" + "a\\'" * 100_000 + "'; // c\n/*" + "x*" * 100_000 + "*/\n`" + "b" * 200_000 + "`"
    assert clean(frame, "a.ts", text)["removed"] == 2


@pytest.mark.parametrize(
    "text, expected",
    [
        ("  a \n\t b ", "a b"),
        ("x" * 60, "x" * 60),
        ("x" * 61, "x" * 57 + "..."),
        ("é" * 31, "é" * 31 + "..."),
    ],
)
def test_preview(frame, text, expected):
    assert frame("t string", (text,)).select(segments.preview(F.col("t"), segments.PREVIEW_BYTES)).collect()[0][0] == expected


def test_previews_and_summary(frame):
    files = frame(
        "project string, path string, content string",
        ("p", "a.ts", "//1\n//2\n//3\n//4\n//5"),
        ("p", "b.ts", "x"),
    )
    cleaned = cleaning.clean_files(files)
    shown = cleaning.previews(cleaned, 3).collect()[0]
    assert (shown["previews"], shown["more"]) == (["//1", "//2", "//3"], 2)
    whole = cleaning.previews(cleaned).collect()[0]
    assert (len(whole["previews"]), whole["more"]) == (5, 0)
    total = cleaning.clean_summary(cleaned).collect()[0].asDict()
    assert total == {
        "files_processed": 2, "files_changed": 1, "comments_removed": 5,
        "bytes_before": 20, "bytes_after": 5, "bytes_saved": 15, "tokens_saved": 4,
    }


def test_the_rewrite_is_not_repeated_by_a_filter(frame):
    files = frame("project string, path string, content string", ("p", "a.ts", "a//x"))
    plan = src.changed_files(cleaning.clean_files(files))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter (isnotnull(removed") < plan.index("Generate inline")

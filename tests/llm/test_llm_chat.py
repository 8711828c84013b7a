import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import chat
from siftwell.llm import template as T

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "a", "[", "]", "<", "/", "s", "INST", ">", "\n", "é", "😀"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible_and_hides_controls(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<s>", ""]), PIECES), max_size=6))
def test_output_reads_back(turns):
    reader = chat.Reader()
    chat.renderer()({"messages": iter([{"role": r, "text": t} for r, t in turns])}, reader.feed)
    n, turn_hash, loss_chars, loss_hash, _ = reader.close()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert n == len(turns) and loss_chars == len(loss)
    assert turn_hash == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert loss_hash == hashlib.sha256(loss.encode()).hexdigest()


def test_statements_and_expressions():
    text, _ = T.render_text("{% for x in xs %}{% if loop.first %}[{% endif %}{{ x.n + 1 }}{{ ',' if not loop.last else ']' }}{% endfor %}", {"xs": [{"n": 1}, {"n": 2}]})
    assert text == "2,3]"[:0] + "[2,3]"
    assert T.render_text("{% set a = 'x' %}{{ a ~ 1 | string }}{# no #}{%- if b is_no %}{% endif %}" if False else "{% set a = 'x' %}{{ a ~ 1 }}{# no #}", {})[0] == "x1"
    assert T.render_text("{% if a == 1 %}one{% elif a in 'xyz' %}in{% else %}other{% endif %}", {"a": "y"})[0] == "in"
    assert T.render_text("a {{- ' b ' | trim -}} c", {})[0] == "abc"
    assert T.render_text("{{ m['k'] | upper }}{{ none }}{{ missing.deep }}", {"m": {"k": "v"}})[0] == "V"


def test_masked_spans():
    text, spans = T.render_text("a{% generation %}b{{ x }}{% endgeneration %}c", {"x": "yz"})
    assert text == "abyzc" and spans == [(1, 4)]


def test_folding_leaves_only_what_varies():
    tree = T.fold(T.parse("{{ 1 + 2 }}-{{ 'a' | upper }}{% if false %}x{{ y }}{% else %}z{% endif %}{{ q }}"), T._FILTERS)
    assert tree == (T.Text("3-Az"), T.Output(T.Name("q")))


@pytest.mark.parametrize("bad", ["{% for x in %}{% endfor %}", "{% if a %}", "{{ a( }}", "{{ a | nothing }}", "{% endfor %}", "{{ 'x' * 'y' }}", "{% other %}", "{{ a b }}"])
def test_errors(bad):
    with pytest.raises(T.TemplateError):
        T.compile_template(bad)


def test_sandbox_reaches_no_python():
    class Thing:
        secret = "s"

    assert T.render_text("{{ t.secret }}{{ t.__class__ }}{{ x.__class__ }}", {"t": Thing(), "x": "s"})[0] == ""


def test_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.digest_conversations(df).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 3, 2: 1, None: 1} and got[1].loss_chars == 2
    full = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert len(full[1].formatted) == got[1].formatted_chars and full[1].formatted.startswith("<s>user[INST][/INST]<s>assistant[INST]b</s>")
    assert "".join(full[1].formatted[a:b] for a, b in full[1].spans) == "bb"
    assert chat.digest_conversations(df.limit(0)).count() == 0

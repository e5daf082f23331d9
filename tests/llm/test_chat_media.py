import random
import tracemalloc

import numpy as np
import pytest

from orrery.llm import chat as C
from orrery.llm import media as M
from orrery.llm import media_build as B


def render(source, **env):
    return C.compile_template(source)(**env)


def test_statements_and_filters():
    assert render("{% for x in xs %}{{ loop.index }}:{{ x | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=["a", "b"])[0] == "1:A, 2:B"
    assert render("{% set a = 1 + 2 * 3 %}{{ a }}{{ 'x' ~ a }}")[0] == "7x7"
    assert render("{% if a is defined and a %}y{% elif b == 'q' %}q{% else %}n{% endif %}", b="q")[0] == "q"
    assert render("{{ m['role'] | default('none') }}-{{ m.nope | default('d') }}", m={"role": "u"})[0] == "u-d"
    assert render("a  {{- ' b ' | trim -}}  c {# note #}d")[0] == "abc d"
    assert render("{{ 'yes' if 2 in [1, 2] else 'no' }}{{ '}}' }}")[0] == "yes}}"


def test_generation_spans():
    text, spans = render("u{% generation %}abc{% endgeneration %}v{% generation %}{{ x }}{% endgeneration %}", x="é€")
    assert [text[a:b] for a, b in spans] == ["abc", "é€"]


def test_constants_are_folded():
    tree = C.fold(C.parse("a{{ 1 + 1 }}b{% if 1 == 1 %}{{ 'c' | upper }}{% else %}{{ gone }}{% endif %}{{ x }}"))
    assert tree == ("block", ("text", ("const", "a2bC")), ("text", ("name", "x")))


@pytest.mark.parametrize("bad", ["{{ a", "{% if a %}", "{{ a | nope }}", "{{ a.__class__ }}", "{{ __x }}", "{% import x %}", "{{ 'a' * 9 }}", "{{ '%d' % 1 }}", "{{ a b }}", "{% for x in y %}", "{{ 1 is odd }}"])
def test_bad_templates_are_refused(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)(a="x", y=[])


def test_no_way_to_python_objects():
    assert render("{{ a.format | default('no') }}{{ a['upper'] | default('no') }}", a="x")[0] == "nono"


def test_chats(spark):
    rows = [(1, 1, "assistant", " hi "), (1, 0, "user", "q"), (2, 0, None, None), (None, 0, "user", ""), (1, 1, "assistant", " hi ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, m string")
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert got[1].rendered == "<|im_start|>user\nq<|im_end|>\n" + "<|im_start|>assistant\nhi<|im_end|>\n" * 2
    for a, b in (map(int, s.split(":")) for s in got[1].spans.split(",")):
        assert got[1].rendered[a:b] == "hi<|im_end|>"
    assert got[2].rendered == "<|im_start|>\n<|im_end|>\n" and got[2].spans == ""
    assert got[None].n_turns == 1
    assert C.format_chats(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "assistant", "w " * 1_000_000)], "conv_id long, turn long, role string, text string")
    assert len(C.format_chats(long).first().rendered) > 1_999_000


def test_container_round_trip():
    picture, sound = bytes(range(256)) * 40, b"s" * 100
    blob = B.container(4, picture, sound)
    video, audio = M.read_container(blob)
    assert (video["codec"], video["handler"], video["timescale"], video["n_samples"]) == ("hvc1", "vide", 12804, 20)
    assert video["duration_ms"] == 20 * 512 * 1000 // 12804
    assert [blob[k["offset"] : k["offset"] + k["size"]] for k in video["keyframes"]] == [picture[:512], picture[12 * 512 : 13 * 512]]
    assert b"".join(blob[k["offset"] : k["offset"] + k["size"]] for k in audio["keyframes"]) == sound


def test_large_sizes_and_open_ends():
    moov = B.container(1, b"p" * 600, b"")
    at = moov.index(b"moov") - 4
    wide = moov[:at] + b"\0\0\0\1moov" + (len(moov) - at + 8).to_bytes(8, "big") + moov[at + 8 :]
    openend = moov[:at] + b"\0\0\0\0moov" + moov[at + 8 :]
    assert M.read_container(wide) == M.read_container(openend) == M.read_container(moov)


def test_compact_sizes_and_wide_offsets():
    body = bytes(4)
    stz2 = memoryview(body + b"\0\0\0\4" + (3).to_bytes(4, "big") + b"\x12\x30")
    same, sizes, n = M._sizes(stz2, {"stz2": (0, len(stz2))})
    assert (same, sizes.tolist(), n) == (0, [1, 2, 3], 3)
    co64 = bytes(4) + (1).to_bytes(4, "big") + (1 << 33).to_bytes(8, "big")
    stsc = bytes(4) + (1).to_bytes(4, "big") + b"".join(x.to_bytes(4, "big") for x in (1, 3, 1))
    data = memoryview(co64 + stsc)
    at = {"co64": (0, len(co64)), "stsc": (len(co64), len(data))}
    assert M._offsets(data, at, same, sizes, n, np.arange(3)).tolist() == [1 << 33, (1 << 33) + 1, (1 << 33) + 3]


def test_broken_containers_are_reported(spark):
    blob = B.container(2, b"p" * 3000, b"s" * 40)
    for n in range(0, len(blob), 7):  # cut anywhere: a reason, no exception
        assert M.read_container(blob[:n])[0]["error"]
    for n in range(0, len(blob), 5):
        M.read_container(blob[:n] + b"\xff" + blob[n + 1 :])
    df = spark.createDataFrame([(1, None, "x"), (2, b"", "x"), (3, blob, "x"), (3, blob, "x"), (None, b"junk", "x")], "page_id long, media binary, codec string")
    got = M.media_columns(df, "page_id", "media").collect()
    assert [r.error for r in got if r.page_id in (1, 2)] == ["no data"] * 2
    assert len([r for r in got if r.page_id == 3]) == 4
    assert M.media_columns(df.limit(0), "page_id", "media").count() == 0


def box(kind, *parts):
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind.encode() + body


def u32(*values):
    return b"".join((x & 0xFFFFFFFF).to_bytes(4, "big") for x in values)


def track(mdhd=None, **tables):
    header = box("mdhd", mdhd if mdhd is not None else u32(0, 0, 0, 1000, 5000, 0))
    return box("moov", box("trak", box("mdia", header, box("minf", box("stbl", *(box(k, v) for k, v in tables.items()))))))


@pytest.mark.parametrize(
    "blob, wrong",
    [
        (track(b""), "no media header"),
        (box("moov", box("trak", box("mdia", box("mdhd")))), "no media header"),
        (track(bytes([1]) + bytes(20)), "no media header"),
        (track(bytes([1]) + bytes(19) + u32(1) + b"\xff" * 7 + b"\xfe" + u32(0)), "the duration is out of range"),
        (track(stts=u32(0, 2, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF), mdhd=u32(0, 0, 0, 1, 0, 0)), "the duration is out of range"),
        (track(stsz=u32(0, 1, 1 << 27), stco=u32(0, 1, 0), stsc=u32(0, 1, 1, 1 << 27, 1)), "more samples than the file has bytes for"),
        (track(stsz=u32(0, 1, 0xFFFFFFFF), stco=u32(0, 1, 0), stsc=u32(0, 1, 1, 0xFFFFFFFF, 1)), "more samples than the file has bytes for"),
        (track(stsz=u32(0, 0xFFFFFFFF, 0xFFFFFFFF), stss=u32(0, 1, 0xFFFFFFFF), stco=u32(0, 1, 0), stsc=u32(0, 1, 1, 0xFFFFFFFF, 1)), "a chunk offset is out of range"),
        (track(stsz=u32(0, 4, 2), co64=u32(0, 1, 0xFFFFFFFF, 0), stsc=u32(0, 1, 1, 2, 1)), "a chunk offset is out of range"),
        (track(stsz=u32(0, 4, 1 << 20), stco=u32(0, 1 << 20), stsc=u32(0, 1, 1, 1, 1)), "more samples than the file has bytes for"),
        (track(stsz=u32(0, 0, 1 << 30)), "stsz is cut off"),
        (track(stsz=u32(0, 4, 2), stss=u32(0, 1, 9), stco=u32(0, 1, 0), stsc=u32(0, 1, 1, 2, 1)), "stss names a sample that is not there"),
        (track(stz2=u32(0, 4, 0xFFFFFFFF)), "stz2 is cut off"),
        (track(stsz=u32(0, 1, 3), stco=u32(0), stsc=u32(0, 1, 1, 2, 1)), "stco is cut off"),
    ],
)
def test_hostile_containers_have_a_reason_and_take_little_memory(spark, blob, wrong):
    tracemalloc.start()
    (found,) = M.read_container(blob)
    assert found["error"] == wrong and tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()


def test_many_equal_samples_with_few_keyframes():
    blob = track(stsz=u32(0, 1000, 1 << 30), stss=u32(0, 2, 1, 1 << 30), stco=u32(0, 2, 100, 200), stsc=u32(0, 1, 1, 1 << 29, 1))
    (found,) = M.read_container(blob)
    assert found["error"] is None and found["n_samples"] == 1 << 30
    assert found["keyframes"] == [{"offset": 100, "size": 1000}, {"offset": 200 + ((1 << 29) - 1) * 1000, "size": 1000}]


def test_an_unknown_duration_is_null(spark):
    for mdhd in (u32(0, 0, 0, 1000, 0xFFFFFFFF, 0), bytes([1]) + bytes(19) + u32(1000) + b"\xff" * 8 + u32(0)):
        blob = track(mdhd, stsz=u32(0, 4, 0), stco=u32(0, 0), stsc=u32(0, 0))
        (found,) = M.read_container(blob)
        assert (found["duration_ms"], found["error"], found["keyframes"]) == (None, None, [])


def test_random_bytes_never_raise(spark):
    rng = random.Random(2)
    good = B.container(2, b"p" * 3000, b"s" * 40)
    hostile = []
    for _ in range(1500):
        x = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(x))
            value = rng.choice([b"\0" * 4, b"\xff" * 4, b"\x7f" + b"\xff" * 3, bytes(rng.randrange(256) for _ in range(4))])
            x[at : at + 4] = value
        hostile.append(bytes(x[: rng.choice([len(x), rng.randrange(len(x))])]))
    hostile += [box(k) for k in ("moov", "trak", "mdhd")] + [box("moov", box("trak", *(box(k) for k in ("tkhd", "mdia"))))]
    for x in hostile:
        M.read_container(x)
    df = spark.createDataFrame(list(enumerate(hostile)), "page_id long, media binary")
    assert M.media_columns(df, "page_id", "media").select("page_id").distinct().count() == len(hostile)

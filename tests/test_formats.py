"""Readers of formats on small files, damaged ones, and a folder."""
import io
import zipfile

from factloom.sources import formats as S


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("--", "."), text)
    return out.getvalue()


def got(path, data):
    return [(kind, text) for _, kind, text, _ in S.parse(path, data)]


MAIL = b"From: Ann <a@x.example>\r\nTo: b@y.example\r\nSubject: Re: Cameras\r\nMessage-ID: <1@x>\r\nIn-Reply-To: <0@x>\r\n\r\nPlease exclude the West Wing.\r\n\r\n> Include all wings.\r\n> From there\r\n"
W = 'xmlns:w="urn:w"'
DOCX = zipped(**{"word__document--xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:p><w:r><w:t>Install </w:t></w:r><w:r><w:t>50</w:t></w:r><w:del><w:r><w:delText>70 units</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = zipped(**{
    "xl__workbook--xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="Sites" r:id="rId1"/></sheets></workbook>',
    "xl___rels__workbook--xml--rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl__sharedStrings--xml": "<sst><si><t>Site</t></si><si><t>Quantity</t></si><si><r><t>Main </t></r><r><t>Campus</t></r></si><si><t>TOTAL</t></si></sst>",
    "xl__worksheets__sheet1--xml": '<worksheet><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><v>50</v></c></row><row r="4"><c r="A4" t="s"><v>3</v></c><c r="C4"><v>50</v></c></row></sheetData></worksheet>',
})


def test_mail_and_mailbox():
    assert got("a.eml", MAIL) == [("mail", "Re: Cameras"), ("authored", "Please exclude the West Wing."), ("quoted", "Include all wings."), ("quoted", "From there")]
    assert S.parse("a.eml", MAIL)[0][3] == {"from": "Ann <a@x.example>", "to": "b@y.example", "subject": "Re: Cameras", "message_id": "<1@x>", "in_reply_to": "<0@x>"}
    box = b"From a@x Mon\n" + MAIL.replace(b"\r\n", b"\n") + b"\nFrom b@y Tue\n" + MAIL.replace(b"\r\n", b"\n")
    rows = S.parse("a.mbox", box)
    assert [r[3]["message"] for r in rows if r[1] == "mail"] == ["1", "2"] and len(rows) == 8
    html = b"Subject: x\nContent-Type: text/html\n\n<p>one</p><p>two</p>"
    assert got("a.eml", html) == [("mail", "x"), ("authored", "one"), ("authored", "two")]


def test_office_files():
    assert got("a.docx", DOCX) == [("heading", "Scope"), ("deleted", "70 units"), ("paragraph", "Install 50"), ("row", "a | b")]
    rows = S.parse("a.xlsx", XLSX)
    assert [(k, t) for _, k, t, _ in rows] == [("header", "Site | Quantity"), ("row", "Main Campus | 50"), ("total", "TOTAL | 50")]
    assert rows[1][3] == {"sheet": "Sites", "row": "3", "Site": "Main Campus", "Quantity": "50"}
    slide = '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
    deck = zipped(**{"ppt__slides__slide10--xml": slide.format("ten"), "ppt__slides__slide2--xml": slide.format("two"), "ppt__notesSlides__notesSlide2--xml": slide.format("say")})
    assert got("a.pptx", deck) == [("paragraph", "two"), ("note", "say"), ("paragraph", "ten")]
    odf = '<o xmlns:t="urn:t" xmlns:x="urn:x"><x:h>Head</x:h><x:p>Body <x:span>text</x:span></x:p><t:table t:name="S"><t:table-row><t:table-cell><x:p>Part</x:p></t:table-cell><t:table-cell><x:p>Note</x:p></t:table-cell><t:table-cell t:number-columns-repeated="16384"/></t:table-row><t:table-row><t:table-cell t:number-columns-repeated="2"><x:p>7</x:p></t:table-cell></t:table-row></t:table></o>'
    assert got("a.ods", zipped(**{"content--xml": odf})) == [("heading", "Head"), ("paragraph", "Body text"), ("header", "Part | Note"), ("row", "7 | 7")]


def test_text_formats():
    assert got("a.csv", b"Part;Qty\r\n\"C;1\";72\r\n;\r\nSubtotal;72\r\n") == [("header", "Part | Qty"), ("row", "C;1 | 72"), ("total", "Subtotal | 72")]
    assert got("a.md", b"# Top #\npara one\nmore\n\n- item\n| a | b |\n|---|---|\n```\nx  y\n```\n") == [("heading", "Top"), ("paragraph", "para one more"), ("item", "item"), ("row", "a | b"), ("code", "x  y")]
    assert got("a.html", b"<html><title>T</title><script>no</script><ul><li><p>a</p>b</li></ul>&amp;c<br>d") == [("title", "T"), ("paragraph", "a"), ("item", "b"), ("paragraph", "&c d")]
    assert got("a.rtf", b"{\\rtf1{\\fonttbl{\\f0 Arial;}}Caf\\'e9 \\u8364? \\b bold\\b0\\par Two \\{x\\}}") == [("paragraph", "Café € bold"), ("paragraph", "Two {x}")]
    assert S.parse("a.ics", b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Kick\r\n off\\, day\r\nDTSTART;TZID=UTC:20240102T030405\r\nEND:VEVENT\r\n")[0][1:] == ("event", "Kickoff, day", {"summary": "Kickoff, day", "dtstart": "20240102T030405"})
    assert [(t, f["path"]) for _, _, t, f in S.parse("a.json", b'{"a": [1, {"b": null}], "c": "x"}')] == [("1", "$.a[0]"), ("", "$.a[1].b"), ("x", "$.c")]
    assert [f["path"] for *_, f in S.parse("a.jsonl", b'{"a": 1}\n\n{"a": 2}\n')] == ["$1.a", "$3.a"]
    assert S.parse("a.srt", b"1\n00:00:01,500 --> 00:00:02,000\nAnn: hi\nthere\n")[0][1:] == ("utterance", "hi there", {"start": "00:00:01.500", "end": "00:00:02.000", "speaker": "Ann"})
    assert S.parse("a.vtt", b"WEBVTT\n\n00:01.000 --> 00:02.000\n<v Bo Lee>go <i>on</i></v>\n")[0][2:] == ("go on", {"start": "00:01.000", "end": "00:02.000", "speaker": "Bo Lee"})
    assert got("a.txt", b"[00:00:01] Ann: hi\nBo: ok\n\nA paragraph: here\nand more\n") == [("utterance", "hi"), ("utterance", "ok"), ("paragraph", "A paragraph: here and more")]


def test_archives_bids_and_damage():
    inner = zipped(**{"deep--md": "# D"})
    rows = S.parse("a.zip", zipped(**{"x__b--csv": "p,q\n1,2\n", "in--zip": inner, "bad--docx": "PK\x03\x04"}))
    assert [(r[0], r[1], r[2], r[3]["member"]) for r in rows] == [("archive", "header", "p | q", "x/b.csv"), ("archive", "row", "1 | 2", "x/b.csv"), ("archive", "heading", "D", "in.zip!deep.md"), ("archive", "unreadable", "", "bad.docx")]
    for _ in range(S.DEEPEST + 1):
        inner = zipped(**{"in--zip": inner})
    assert [r[1] for r in S.parse("a.zip", inner)] == ["not_opened"]
    assert S.bids("x", MAIL)[0][0] == "mail" and S.bids("x.DOCX", DOCX)[0] == ("word", 0.95) and S.bids("x", b"\0\1") == [] and S.parse("x", b"") == []
    assert S.parse("x", b"\0\1")[0][1] == "unreadable"
    for name, (_, suffixes, _) in S.READERS.items():
        for data in (b"\xff\xfe\x00", b"{" * 5000, b"PK\x03\x04junk", b"\n", MAIL[:40]):
            assert all(len(r) == 4 for r in S.parse("a" + suffixes[0], data)), name


def test_a_folder_of_files(spark, tmp_path):
    for name, data in {"a.eml": MAIL, "s/b.docx": DOCX, "c.md": b"# H", "d.bin": b"\0", "e.txt": b"", "f.csv": b"x" * 5000, "g.mine": b"own"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)

    def own(data):
        yield "own", data.decode(), {}

    S.register("mine", own, (".mine",))
    try:
        rows = S.read_files(spark, str(tmp_path), 4000).collect()
    finally:
        del S.READERS["mine"]
    counts = {}
    for r in rows:
        counts.setdefault(r["path"].rsplit("/", 1)[-1], []).append((r["place"], r["format"], r["kind"]))
    assert counts["f.csv"] == [(0, "none", "too_large")] and counts["d.bin"] == [(0, "none", "unreadable")] and "e.txt" not in counts
    assert counts["g.mine"] == [(0, "mine", "own")] and counts["c.md"] == [(0, "markdown", "heading")]
    assert sorted(p for p, *_ in counts["a.eml"]) == [0, 1, 2, 3] and len(counts["b.docx"]) == 4

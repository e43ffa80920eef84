import re
import tempfile
from pathlib import Path

import pytest

from wellstream.operators import welllog
from wellstream.sources.welllogs import read_pieces, read_well_logs

CURVES = {"DEPT": ("m", "-999.25"), "DTIM": ("", ""), "GR": ("gAPI", "-999.25"), "SPP": ("psi", ""), "TEMP": ("degC", "")}
LINES = ["412.5,2023-03-09T17:20:00Z,61.25,7130,88.5", "416.5,2023-03-09T17:25:00Z,64.5,7155,88.75"]


def document(lines=LINES, mnemonics="DEPT,DTIM,GR,SPP,TEMP", units="m,,gAPI,psi,degC", curves=CURVES, version="1.4.1.1",
             index_type="measured depth", index_curve="DEPT", logs=1, xmlns="http://www.witsml.org/schemas/1series",
             well=' uidWell="W-1"', extra_data="", head="<nameWell>North 1</nameWell>", data=None, lists=None, prolog=""):
    info = "".join(
        f"<logCurveInfo uid='{m}'><mnemonic>{m}</mnemonic><unit>{u}</unit><nullValue>{n}</nullValue></logCurveInfo>"
        for m, (u, n) in curves.items())
    data = "".join(f"<data>{line}</data>" for line in lines) if data is None else data
    lists = f"<mnemonicList>{mnemonics}</mnemonicList><unitList>{units}</unitList>" if lists is None else lists
    log = (
        f'<log{well} uidWellbore="WB-1" uid="L-1">{head}<nameWellbore>Main</nameWellbore><name>run</name>'
        f"<indexType>{index_type}</indexType><indexCurve>{index_curve}</indexCurve>{info}<logData>"
        f"{lists}{data}</logData>{extra_data}</log>")
    return f'<?xml version="1.0"?>\n{prolog}<logs xmlns="{xmlns}" version="{version}">{log * logs}</logs>'


def prefixed(text, prefix="w"):
    """The same document with a prefix for the namespace."""
    named = re.sub(r"<(/?)(?=[A-Za-z])", rf"<\1{prefix}:", text)
    return named.replace("xmlns=", f"xmlns:{prefix}=", 1)


FIRST, SECOND = (f"<data>{line}</data>" for line in LINES)
DOCUMENTS = {
    "good": document(),
    "prefixed": prefixed(document()),
    "prefix of one element": document().replace("<nameWell>North 1</nameWell>", '<x:nameWell xmlns:x="http://www.witsml.org/schemas/1series">North 1</x:nameWell>'),
    "element of another namespace": document().replace("<nameWell>North 1</nameWell>", '<nameWell xmlns="urn:other">South</nameWell><nameWell>North 1</nameWell>'),
    "lines of another namespace": document(data=f'{FIRST}<data xmlns="urn:other">x</data><y:data xmlns:y="urn:other">x</y:data>{SECOND}'),
    "byte order mark": "\ufeff" + document(),
    "comments": document(data=f"<!-- a > b -->{FIRST}<!-- <data>x</data> -->\n<!-- <data>y</data>{FIRST} <b -->{SECOND}<!---->"),
    "comment in a line": document(data=FIRST.replace("412.5", "412<!-- , -->.5") + SECOND),
    "character sections": document(data=FIRST.replace("412.5", "<![CDATA[412]]>.5") + SECOND.replace(LINES[1], f"<![CDATA[{LINES[1]}]]>")),
    "entities": document(data=FIRST.replace("412.5", "&#52;12.5") + SECOND, head="<nameWell> North&#x20;1 </nameWell>"),
    "named entities": document(["412.5,2023-03-09T17:20:00Z,61.25,7130,88.5,a&amp;amp;b &lt;", "416.5,2023-03-09T17:25:00Z,64.5,7155,88.75,"], "DEPT,DTIM,GR,SPP,TEMP,NOTE", "m,,gAPI,psi,degC,"),
    "line with attributes": document(data=FIRST.replace("<data>", "<data id='1'>") + SECOND),
    "line with a child": document(data=FIRST.replace("412.5", "412<i>.5</i>") + SECOND),
    "unusual blanks": document(data=f"<data>\n\u00a0{LINES[0]}\u2003</data >\n{SECOND}", head="<nameWell>\u3000North 1\u0085</nameWell>"),
    "lines elsewhere": document(data=f"{FIRST}<group><data>x</data></group>{SECOND}", extra_data="<data>x</data>"),
    "reordered": document(["61.25,7130,88.5,412.5,2023-03-09T17:20:00+02:00"], "GR, SPP,TEMP,DEPT,DTIM", "gAPI,psi,degC,m,"),
    "feet": document(["640.5,2023-03-09T17:20:00Z,1,2,3", "655.5,2023-03-09T17:25:00Z,1,2,3"], units="ft,,gAPI,psi,degC"),
    "tripping": document(["416.5,2023-03-09T17:20:00Z,1,2,3", "412.5,2023-03-09T17:25:00Z,1,2,3"]),
    "trailing sign": document(["5+,2023-03-09T17:20:00Z,1,2-,.5"]),
    "last of equal names": document(["1,2023-03-09T17:20:00Z,5,2,3,9"], "DEPT,DTIM,GR,SPP,TEMP,GR", "m,,gAPI,psi,degC,gAPI"),
    "second data block": document(extra_data="<logData><mnemonicList>X</mnemonicList></logData>"),
    "no lines": document([]),
    "empty time": document([LINES[0], "416.5,,64.5,7155,88.75"]),
    "null depth": document([LINES[0], "-999.25,2023-03-09T17:25:00Z,64.5,7155,88.75"]),
    "kilometres": document(units="km,,gAPI,psi,degC"),
    "wrong gamma unit": document(units="m,,API,psi,degC"),
    "no curve info": document(curves={k: v for k, v in CURVES.items() if k != "SPP"}),
    "no mnemonic": document(["412.5,2023-03-09T17:20:00Z,61.25,7130"], "DEPT,DTIM,GR,SPP", "m,,gAPI,psi"),
    "index curve not listed": document(index_curve="MD"),
    "unit count": document(units="m,,gAPI,psi"),
    "field count": document([LINES[0], "416.5,2023-03-09T17:25:00Z,64.5"]),
    "equal times": document([LINES[0], LINES[0]]),
    "earlier time": document([LINES[1], LINES[0]]),
    "no offset": document(["412.5,2023-03-09T17:20:00,61.25,7130,88.5"]),
    "exponent": document(["1e3,2023-03-09T17:20:00Z,61.25,7130,88.5"]),
    "nan": document(["412.5,2023-03-09T17:20:00Z,NaN,7130,88.5"]),
    "negative gamma": document(["412.5,2023-03-09T17:20:00Z,-1,7130,88.5"]),
    "negative depth": document(["-1,2023-03-09T17:20:00Z,1,7130,88.5"]),
    "first error wins": document(["x,,1,7130,88.5", "-1,2023-03-09T17:20:00Z,1,7130,88.5"]),
    "version": document(version="1.3.1.1"),
    "index type": document(index_type="date time"),
    "two logs": document(logs=2),
    "no log": document(logs=0),
    "namespace": document(xmlns="http://example.org/other"),
    "no well id": document(well=""),
    "no well name": document(head=""),
    "bad xml": document()[:-12],
    "bad line": document(data=FIRST + SECOND.replace("</data>", "</date>")),
    "unknown entity": document(data=FIRST + SECOND.replace("416", "&deg;416")),
    "lone ampersand": document(data=FIRST.replace("412", "4 & 12") + SECOND),
    "control character": document(data=FIRST + SECOND.replace("416", "\x01416")),
    "text after the end": document() + "x",
    "text before the start": "x" + document(),
    "unfinished comment": document(data=f"{FIRST}<!-- {SECOND}"),
    "unbound prefix": prefixed(document()).replace("xmlns:w=", "xmlns:v=", 1),
    "empty": "",
    "blank": " \n",
    "no mnemonic list": document(lists="<unitList>m,,gAPI,psi,degC</unitList>"),
    "no unit list": document(lists="<mnemonicList>DEPT,DTIM,GR,SPP,TEMP</mnemonicList>"),
    "prefix only on the root": prefixed(document()).replace("<w:log ", "<log ").replace("</w:log>", "</log>"),
    "other root": "<wells><well/></wells>",
}
REASONS = {
    "empty time": "Data line 2: DTIM has an empty value",
    "null depth": "Data line 2: DEPT uses the null value '-999.25'",
    "kilometres": "curve DEPT has unsupported unit 'km'",
    "wrong gamma unit": "curve GR has unsupported unit 'API'",
    "no curve info": "required mnemonic SPP has no curve info",
    "no mnemonic": "required mnemonic TEMP is not in the mnemonic list",
    "index curve not listed": "index curve MD is not in the mnemonic list",
    "unit count": "5 columns in the mnemonic list but 4 in the unit list",
    "field count": "Data line 2: 3 fields but 5 columns",
    "equal times": "Data line 2: time is not later than that of the previous line",
    "earlier time": "Data line 2: time is not later than that of the previous line",
    "no offset": "Data line 1: DTIM is not an ISO 8601 time with offset",
    "exponent": "Data line 1: DEPT is not a valid number",
    "nan": "Data line 1: GR is not a valid number",
    "negative gamma": "Data line 1: GR is negative",
    "negative depth": "Data line 1: DEPT is negative",
    "first error wins": "Data line 1: DEPT is not a valid number",
    "version": "unsupported version, expected 1.4.1.1, found 1.3.1.1",
    "index type": "unsupported index type 'date time'",
    "two logs": "only one log per document, found 2",
    "no log": "no log element",
    "namespace": "root element is not in the log namespace",
    "no well id": "required attribute 'uidWell' is missing",
    "no well name": "required element 'nameWell' is missing",
    "bad xml": "invalid XML",
    **dict.fromkeys(["bad line", "unknown entity", "lone ampersand", "control character", "text after the end", "text before the start",
                     "unfinished comment", "unbound prefix", "empty", "blank"], "invalid XML"),
    "other root": "root element is not in the log namespace",
    "no mnemonic list": "required element 'mnemonicList' is missing",
    "no unit list": "required element 'unitList' is missing",
    "prefix only on the root": "no log element",
}


@pytest.fixture(scope="module", params=[1 << 20, 1], ids=["one slice", "a slice per line"])
def imported(spark, request):
    folder = Path(tempfile.mkdtemp(prefix="wellstream-logs-"))
    names = {}
    for i, (name, text) in enumerate(DOCUMENTS.items()):
        (folder / f"{i:02d}.xml").write_text(text)
        names[f"{i:02d}.xml"] = name
    documents, lines = read_well_logs(spark, str(folder), "RIG-7")
    resolved = welllog.resolve(documents)
    mapped = welllog.map_lines(welllog.join_lines(resolved, lines), request.param)
    rejected = welllog.import_rejects(resolved, mapped)
    readings = welllog.import_readings(mapped, rejected, "run-1").collect()
    by_session = {}
    for row in resolved.select("path", welllog.import_session(resolved.path, resolved.device_id, "run-1").alias("s")).collect():
        by_session[row.s] = names[row.path.rsplit("/", 1)[1]]
    found = {}
    for r in sorted(readings, key=lambda r: r.sequence_number):
        found.setdefault(by_session[r.acquisition_session_id], []).append(r)
    reasons = {names[r.path.rsplit("/", 1)[1]]: r.reason for r in rejected.collect()}
    summary = {names[r.path.rsplit("/", 1)[1]]: r for r in welllog.import_summary(resolved, mapped, rejected).collect()}
    return found, reasons, summary


def test_rejects(imported):
    assert imported[1] == REASONS


def test_accepted_documents(imported):
    found, reasons, _ = imported
    assert set(found) | {"no lines"} == set(DOCUMENTS) - set(reasons)


def test_readings(imported):
    first, second = imported[0]["good"]
    assert (first.sequence_number, second.sequence_number) == (1, 2)
    assert (first.device_id, first.well_id, first.well_name, first.wellbore_id, first.wellbore_name) == (
        "RIG-7", "W-1", "North 1", "WB-1", "Main")
    assert (first.drilling_operation, first.depth_change_rate_metres_per_hour) == ("Stationary", 0.0)
    assert second.drilling_operation == "DrillingAhead"
    assert second.depth_change_rate_metres_per_hour == pytest.approx(48.0)
    assert (first.gamma_ray_api, first.pressure_psi, first.temperature_celsius) == (61.25, 7130.0, 88.5)
    assert {r.acquisition_mode for r in imported[0]["good"]} == {"HistoricalImport"}


@pytest.mark.parametrize("name", [
    "prefixed", "prefix of one element", "element of another namespace", "lines of another namespace", "byte order mark", "comments", "comment in a line",
    "character sections", "entities", "named entities", "line with attributes", "line with a child", "unusual blanks", "lines elsewhere", "second data block"])
def test_the_same_log_in_other_words(imported, name):
    plain = [[v for c, v in r.asDict().items() if c != "acquisition_session_id"] for r in imported[0]["good"]]
    assert [[v for c, v in r.asDict().items() if c != "acquisition_session_id"] for r in imported[0][name]] == plain


def test_one_file_makes_many_tasks(spark):
    folder = Path(tempfile.mkdtemp(prefix="wellstream-large-"))
    rows = [f"{412.5 + i / 2},2023-03-09T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z,{i % 90},7130,88.5" for i in range(20_000)]
    data = "".join(f"<w:data>{line}</w:data>\n" + "<!-- <w:data>x</w:data>\n -->" * (i % 7 == 0) for i, line in enumerate(rows))
    text = prefixed(document(["@"])).replace("<w:data>@</w:data>", data)
    (folder / "large.xml").write_text(text)
    settings = {"spark.sql.files.maxPartitionBytes": "40k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pieces = read_pieces(spark, str(folder))
        assert pieces.select("block").distinct().count() >= 30
        documents, lines = read_well_logs(spark, str(folder), "RIG-7")
        (parts,) = documents.select("parts").first()
        assert len(parts) < 120
        assert [r.line for r in lines.orderBy("line_no").collect()] == rows
        assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, len(rows) + 1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_columns_are_found_by_name(imported):
    row = imported[0]["reordered"][0]
    assert (row.measured_depth_metres, row.gamma_ray_api, row.temperature_celsius) == (412.5, 61.25, 88.5)
    assert row.timestamp_utc.isoformat() == "2023-03-09T15:20:00"
    assert imported[0]["last of equal names"][0].gamma_ray_api == 9.0


def test_numbers_and_units(imported):
    feet = imported[0]["feet"]
    assert [round(r.measured_depth_metres, 4) for r in feet] == [round(640.5 * 0.3048, 4), round(655.5 * 0.3048, 4)]
    signed = imported[0]["trailing sign"][0]
    assert (signed.measured_depth_metres, signed.pressure_psi, signed.temperature_celsius) == (5.0, -2.0, 0.5)
    assert imported[0]["tripping"][1].depth_change_rate_metres_per_hour == pytest.approx(-48.0)
    assert imported[0]["tripping"][1].drilling_operation == "TrippingOut"


def test_file_names_are_no_reason(spark):
    folder = Path(tempfile.mkdtemp(prefix="wellstream-names-"))
    for name in ("with space.xml", "pct%41.xml", "größe.xml", "plain.xml"):
        (folder / name).write_text(document())
    documents, lines = read_well_logs(spark, str(folder), "RIG-7")
    resolved = welllog.resolve(documents)
    rejected = welllog.import_rejects(resolved, welllog.map_lines(welllog.join_lines(resolved, lines), 1 << 20))
    assert (resolved.count(), rejected.count()) == (4, 0)


def test_summary(imported):
    _, reasons, summary = imported
    assert set(summary) == set(DOCUMENTS)
    assert (summary["good"].data_rows, summary["good"].readings) == (2, 2)
    assert (summary["null depth"].data_rows, summary["null depth"].readings) == (2, 0)
    assert summary["null depth"].reason == reasons["null depth"]

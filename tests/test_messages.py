import json

import pytest
from pyspark.sql import functions as F

from wellstream.functions import predicates as P
from wellstream.operators import ingest

GOOD = {
    "DeviceId": "D1", "AcquisitionSessionId": "ABCDEF11-1111-4111-8111-111111111111", "SequenceNumber": 1, "WellId": "W",
    "WellName": "n", "WellboreId": "b", "WellboreName": "m", "MeasuredDepthMetres": 1.5, "DrillingOperation": "DrillingAhead",
    "DepthChangeRateMetresPerHour": 3, "PressurePsi": 1, "TemperatureCelsius": 2.5, "GammaRayApi": 3,
    "TimestampUtc": "2024-01-01T00:00:00.1234567+02:00", "AcquisitionMode": "HistoricalImport",
}


def message(without=None, **changed):
    return json.dumps({k: v for k, v in {**GOOD, **changed}.items() if k != without})


CASES = {
    "good": (message(), None),
    "unknown nested member": (message(Other={"DeviceId": 5}), None),
    "unknown list": (message(Other=[{"WellId": None}]), None),
    "number for text": (message(DeviceId=5), P.BAD_JSON),
    "null for text": (message(WellId=None), P.BAD_JSON),
    "fraction for integer": (message(SequenceNumber=1.0), P.BAD_JSON),
    "text for integer": (message(SequenceNumber="1"), P.BAD_JSON),
    "text for number": (message(MeasuredDepthMetres="NaN"), P.BAD_JSON),
    "not json": ("{broken", P.BAD_JSON),
    "cut off": (message()[:40], P.BAD_JSON),
    "null": ("null", P.BAD_JSON),
    "list": ("[]", P.BAD_JSON),
    "bad session": (message(AcquisitionSessionId="x"), P.BAD_JSON),
    "bad time": (message(TimestampUtc="yesterday"), P.BAD_JSON),
    "escaped name, bad type": (message().replace('"DeviceId": "D1"', '"Device\\u0049d": 7'), P.BAD_JSON),
    "number for enum": (message(DrillingOperation=1), None),
    "number of no member": (message(DrillingOperation=9), P.BAD_OPERATION),
    "number of a mode": (message(AcquisitionMode=1), None),
    "single quotes": (message().replace('"', "'"), P.BAD_JSON),
    "text after the object": (message() + " xyz", P.BAD_JSON),
    "two objects": (message() + message(), P.BAD_JSON),
    "two listed objects": (message() + "," + message(), P.BAD_JSON),
    "closing bracket": (message() + "]", P.BAD_JSON),
    "blanks after the object": (message() + " \n", None),
    "brace in text": (message(WellName="a}b"), None),
    "no-break space": (message(DeviceId="\u00a0"), P.BLANK_DEVICE),
    "empty": ("{}", P.BLANK_DEVICE),
    "blank device": (message(DeviceId=" \t"), P.BLANK_DEVICE),
    "empty session": (message(AcquisitionSessionId="00000000-0000-0000-0000-000000000000"), P.EMPTY_SESSION_ID),
    "no session": (message("AcquisitionSessionId"), P.EMPTY_SESSION_ID),
    "zero sequence": (message(SequenceNumber=0), P.BAD_SEQUENCE),
    "blank well": (message(WellId=""), P.BLANK_WELL),
    "blank well name": (message(WellName=""), P.BLANK_WELL_NAME),
    "blank wellbore": (message(WellboreId=""), P.BLANK_WELLBORE),
    "no wellbore name": (message("WellboreName"), P.BLANK_WELLBORE_NAME),
    "negative depth": (message(MeasuredDepthMetres=-1), P.BAD_DEPTH),
    "unknown operation": (message(DrillingOperation="Reaming"), P.BAD_OPERATION),
    "operation in lower case": (message(DrillingOperation="drillingahead"), None),
    "wrong rate": (message(DepthChangeRateMetresPerHour=-3), P.BAD_RATE),
    "default operation with rate": (message("DrillingOperation"), P.BAD_RATE),
    "negative gamma": (message(GammaRayApi=-0.1), P.BAD_GAMMA),
    "unknown mode": (message(AcquisitionMode="Replay"), P.BAD_MODE),
    "no mode": (message("AcquisitionMode"), None),
    "negative pressure": (message(PressurePsi=-5), None),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, "arrival_no long, value string").withColumn(
        "received_at_utc", F.lit("2024-01-01").cast("timestamp"))
    # As text, because Python cannot hold the default time in every time zone.
    found = ingest.validate(ingest.parse_messages(df)).withColumn(
        "timestamp_utc", F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).collect()
    return {name: next(r for r in found if r.arrival_no == i) for i, name in enumerate(CASES)}


@pytest.mark.parametrize("name", CASES)
def test_reject_reason(parsed, name):
    assert parsed[name].reject_reason == CASES[name][1]


def test_typed_values(parsed):
    good = parsed["good"]
    assert good.acquisition_session_id == GOOD["AcquisitionSessionId"].lower()
    assert good.timestamp_utc == "2023-12-31T22:00:00.123456"
    assert parsed["number for enum"].drilling_operation == "DrillingAhead"
    assert parsed["number of a mode"].acquisition_mode == "HistoricalImport"
    assert parsed["operation in lower case"].drilling_operation == "DrillingAhead"
    assert (good.acquisition_mode, parsed["no mode"].acquisition_mode) == ("HistoricalImport", "RealTime")


def test_rejects_keep_the_raw_message(spark):
    df = spark.createDataFrame([(1, "{broken")], "arrival_no long, value string").withColumn(
        "received_at_utc", F.lit("2024-01-01").cast("timestamp"))
    row = ingest.rejects(ingest.validate(ingest.parse_messages(df))).first()
    assert (row.value, row.reject_reason) == ("{broken", P.BAD_JSON)


@pytest.mark.parametrize("text, ordinary", [
    ('{"DeviceId":"a } b","SequenceNumber":12, "GammaRayApi": -1.5e-3}', True),
    ('{"DeviceId":7}', False), ('{"DeviceId":"a"}{}', False), ('{"DeviceId":"a"} 1', False), ('{"DeviceId":"a",}', False),
    ('{"DeviceId":"a" "WellId":"b"}', False), ('{"DeviceId":"\\u0061"}', False), ('{"SequenceNumber":1.0}', False),
    ('{"SequenceNumber":01}', False), ('{"Other":"a"}', False), ('{"DeviceId":"a\nb"}', False), ("{}", False), (None, False),
    ("{" + ",".join(['"DeviceId":"a"'] * 40_000) + "}", False),
])
def test_ordinary_messages_pass_the_exact_checks_too(spark, text, ordinary):
    row = spark.createDataFrame([(text,)], "value string").select(
        ingest._ordinary().alias("quick"), (~ingest._wrong_type() & ingest._one_value()).alias("exact")).first()
    assert row.quick == ordinary and (row.exact or not ordinary)

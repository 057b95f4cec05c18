"""Fields of CDM18 JSON log records, read by pattern from the line text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed text of the public CDM18 record format.
CDM = "com.bbn.tc.schema.avro.cdm18."
NODE_KINDS = ["Subject", "FileObject", "NetFlowObject"]
# Record kinds that describe no node.
NO_NODE_KINDS = ["Event", "Host", "TimeMarker", "StartMarker", "UnitDependency", "EndMarker"]
# Node kinds named by the record itself when it has no type field.
UNTYPED_KINDS = ["MemoryObject", "NetFlowObject", "UnnamedPipeObject"]

STRICT = {
    "Subject": r'Subject":\{"uuid":"(.*?)"(.*?)"cmdLine":\{"string":"(.*?)"\}(.*?)"properties":\{"map":\{"tgid":"(.*?)"',
    "FileObject": r'FileObject":\{"uuid":"(.*?)"(.*?)"filename":"(.*?)"',
    "NetFlowObject": r'NetFlowObject":\{"uuid":"(.*?)"(.*?)"localAddress":"(.*?)","localPort":(.*?),'
                     r'"remoteAddress":"(.*?)","remotePort":(.*?),',
}


def is_record(line: Column, kind: str) -> Column:
    return F.contains(line, F.lit(f'{{"datum":{{"{CDM}{kind}"'))


def field(line: Column, pattern: str) -> Column:
    """First group of ``pattern``, null when it does not match."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))


def uuid_of(line: Column, key: str) -> Column:
    return field(line, rf'"{key}":\{{"{CDM}UUID":"(.*?)"')


def record_type(line: Column) -> Column:
    return field(line, r'"type":"(.*?)"')


def timestamp_ns(line: Column) -> Column:
    return field(line, r'"timestampNanos":(.*?),').try_cast("bigint")


def node_kind(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for k in NODE_KINDS:
        out = F.when(is_record(line, k), F.lit(k)).otherwise(out)
    return out


def node_uuid(line: Column) -> Column:
    return field(line, r'"datum":\{"[^"]*":\{"uuid":"(.*?)"')


def strict_property(line: Column) -> Column:
    """Node property; null when any part is missing, so the record is dropped."""
    def part(kind: str, i: int) -> Column:
        return F.regexp_extract(line, STRICT[kind], i)
    path = F.coalesce(field(line, r'"path":"(.*?)"'), F.lit("null"))
    return (F.when(is_record(line, "Subject") & line.rlike(STRICT["Subject"]),
                   F.concat_ws(",", part("Subject", 3), part("Subject", 5), path))
            .when(is_record(line, "FileObject") & line.rlike(STRICT["FileObject"]), part("FileObject", 3))
            .when(is_record(line, "NetFlowObject") & line.rlike(STRICT["NetFlowObject"]),
                  F.concat_ws(",", *[part("NetFlowObject", i) for i in (3, 4, 5, 6)])))


def lenient_property(line: Column) -> Column:
    """Node property with 'null' for each missing part."""
    def get(pattern: str) -> Column:
        return F.coalesce(field(line, pattern), F.lit("null"))

    def port(name: str) -> Column:
        return F.regexp_replace(get(rf'"{name}":(.*?),'), '^"+|"+$', "")
    return (F.when(is_record(line, "Subject"),
                   F.concat_ws(",", get(r'"cmdLine":\{"string":"(.*?)"'), get(r'"properties":\{"map":\{"tgid":"(.*?)"'),
                               get(r'"path":"(.*?)"')))
            .when(is_record(line, "FileObject"), get(r'"filename":"(.*?)"'))
            .when(is_record(line, "NetFlowObject"),
                  F.concat_ws(",", get(r'"localAddress":"(.*?)"'), port("localPort"), get(r'"remoteAddress":"(.*?)"'),
                              port("remotePort"))))

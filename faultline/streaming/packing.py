"""Rows packed into one binary value, in the Arrow stream format, on their way through a keyed step."""


def to_bytes(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all()

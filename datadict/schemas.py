"""Explicit schemas of the catalog dump relations.

A dump holds one relation for many servers; ``source_id`` names the server and is either a column
of the files or a partition directory. Reading with these schemas avoids inference passes and
makes missing columns appear as nulls, which ``sources.decode`` then replaces by defaults.
"""

from pyspark.sql import types as T

S, I, L, B, Y = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.BinaryType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


MYSQL = {
    "schemata": _struct(source_id=S, schema_name=S),
    "tables": _struct(source_id=S, schema_name=S, table_name=S, table_type=S, engine=S,
                      row_format=S, table_collation=S, table_comment=S),
    "columns": _struct(source_id=S, schema_name=S, table_name=S, column_name=S, ordinal_position=I,
                       column_default=S, is_nullable=S, column_type=S, character_set_name=S,
                       collation_name=S, column_key=S, extra=S, generation_expression=S,
                       column_comment=S),
    "statistics": _struct(source_id=S, schema_name=S, table_name=S, index_name=S, non_unique=I,
                          column_name=S, seq_in_index=I),
    "key_column_usage": _struct(source_id=S, schema_name=S, table_name=S, constraint_name=S,
                                column_name=S, ordinal_position=I, referenced_table_name=S,
                                referenced_column_name=S),
    "referential_constraints": _struct(source_id=S, schema_name=S, constraint_name=S,
                                       delete_rule=S, update_rule=S),
    "show_create": _struct(source_id=S, schema_name=S, table_name=S, create_table=Y, create_view=Y,
                           character_set_client=S, collation_connection=S),
}

POSTGRES = {
    "schemata": _struct(source_id=S, schema_name=S),
    "tables": _struct(source_id=S, schema_name=S, table_name=S, table_type=S),
    "columns": _struct(source_id=S, schema_name=S, table_name=S, column_name=S, ordinal_position=I,
                       column_default=S, is_nullable=S, udt_name=S, char_max_length=I,
                       numeric_precision=I, numeric_scale=I, collation_name=S,
                       generation_expression=S),
    "pg_class": _struct(source_id=S, oid=L, relname=S, relnamespace=L, relkind=S, description=S),
    "pg_namespace": _struct(source_id=S, oid=L, nspname=S),
    "pg_attribute": _struct(source_id=S, attrelid=L, attnum=I, attname=S, attisdropped=B,
                            attidentity=S, attgenerated=S, description=S),
    "pg_index": _struct(source_id=S, indexrelid=L, indrelid=L, indkey=S, indisprimary=B,
                        indisunique=B, indexname=S, indexdef=S),
    "pg_constraint": _struct(source_id=S, oid=L, conrelid=L, conname=S, contype=S, conkey=S,
                             confkey=S, confrelid=L, conindid=L, condef=S),
    "pg_database": _struct(source_id=S, datcollate=S),
    "views": _struct(source_id=S, schema_name=S, table_name=S, view_query=S),
}

RELATIONS = {"mysql": MYSQL, "postgres": POSTGRES}


def normalise_dialect(name: str) -> str:
    """`mysql`, `postgres` or the alias `postgresql`, in any case."""
    wanted = name.strip().lower()
    wanted = {"postgresql": "postgres"}.get(wanted, wanted)
    if wanted not in RELATIONS:
        raise ValueError(f"unknown dialect: {name!r}")
    return wanted

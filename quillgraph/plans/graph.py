"""A property graph as DataFrames; every key is (file, id), ids being unique in a file only."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(text: str, kinds: dict) -> T.StructType:
    return T.StructType([T.StructField(n, kinds.get(n, _S)) for n in text.split()])


_LONGS = dict.fromkeys(
    """id parent_id function_id line column end_line end_column argument_count string_length array_size function
    block_ord node_id src dst arm caller_fn call_id callee_id call_node idx""".split(),
    _L,
)
_BOOLS = dict.fromkeys("is_constructor is_destructor is_virtual is_setjmp_target".split(), _B)
_LISTS = {"base_classes": T.ArrayType(_S), "children": T.ArrayType(_L), "field_names": T.ArrayType(_S), "field_path": T.ArrayType(_S), "arg_positions": T.ArrayType(_L)}
_ALL = _LONGS | _BOOLS | _LISTS

#: Fields of the side tables of languages: fixed values, the names that rules are written in. Those that begin
#: with is_ or has_ are booleans, as are the ones named in META_BOOLS; META_LISTS are lists, of which a rule sees
#: the first; the others are texts.
META = {
    "cpp": """class_context namespace visibility qualified_name is_constructor is_destructor is_virtual is_virtual_dispatch
        template_params base_classes""",
    "go": """package_name receiver_type receiver_name qualified_name is_exported is_variadic is_interface is_goroutine
        is_deferred is_closure is_init is_alias is_const embedded_interfaces generic_type_params""",
    "python": """is_async is_generator is_staticmethod is_classmethod is_property is_abstract is_augmented
        is_constructor_call is_super_call is_dunder_call is_yield_from has_star_args has_double_star_args is_star_param
        is_double_star_param is_keyword_only return_annotation annotation metaclass call_receiver_text decorators
        closure_vars""",
    "java": """package_name fully_qualified_class enclosing_class extends_type label_target is_interface is_enum is_record
        is_abstract is_final is_sealed is_anonymous is_static is_synchronized is_native is_varargs is_virtual_dispatch
        is_this_call is_super_call is_static_import has_finally access_modifiers annotations throws_types
        generic_type_params implements_types catch_types""",
    "js": """is_async is_generator is_arrow is_constructor is_getter is_setter is_static is_private is_delegate is_for_of
        module_kind scope_kind class_context export_kind import_source decorator_names""",
    "ts": """is_async is_abstract is_readonly is_optional is_definite_assignment is_ambient is_declare is_override is_using
        enum_is_const module_is_namespace access_modifier type_annotation extends_type satisfies_type decorator_names
        implements_types type_arguments generic_constraints""",
    "rust": """visibility abi self_type trait_type is_async is_unsafe is_const is_extern is_mut is_move_closure
        use_after_move is_unsafe_context is_no_std derive_macros lifetimes generic_params where_clauses trait_bounds""",
}
META_BOOLS = ["enum_is_const", "module_is_namespace", "use_after_move"]
META_LISTS = """template_params base_classes embedded_interfaces generic_type_params decorators closure_vars access_modifiers
    annotations throws_types implements_types catch_types decorator_names type_arguments generic_constraints derive_macros
    lifetimes generic_params where_clauses trait_bounds""".split()
for _field in " ".join(META.values()).split():
    if _field in META_LISTS:
        _ALL[_field] = T.ArrayType(_S)
    elif _field.startswith(("is_", "has_")) or _field in META_BOOLS:
        _ALL[_field] = _B

SCHEMAS = {
    name: _struct(text, _ALL)
    for name, text in {
        "nodes": """file lang id kind node_type name text parent_id function_id line column end_line end_column operator
            lit_kind loop_kind try_kind argument_count string_length array_size array_size_expr signature class_context
            namespace visibility is_constructor is_destructor is_virtual qualified_name base_classes children field_names""",
        "blocks": "file function block_key block_ord is_setjmp_target",
        "block_nodes": "file function block_ord node_id",
        "cfg_edges": "file function src dst arm kind",
        "dfg_edges": "file src dst variable edge_type field_path",
        "call_sites": "file caller_fn call_id callee callee_id qualified_callee callee_kind",
        "xcalls": "file call_node caller_fn callee_name qualified_callee arg_positions",
        "param_effects": "file fn_name effect idx",
        "supertypes": "file child parent",
        **{f"meta_{k}": f"file id {v}" for k, v in META.items()},
    }.items()
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the schema in its order and types; absent ones are null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
    )


@dataclass
class Graph:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """The table in its schema.  Its joins are merges: what exploded rows or compressed files let the planner guess
        is far below the rows that a broadcast would hold in the driver."""
        if name in self.tables:
            return conform(self.tables[name], name).hint("merge")
        return conform(self.spark.range(0), name).where(F.lit(False))

    def only(self, **tables: DataFrame) -> Graph:
        return replace(self, tables=self.tables | tables)

    def written(self, *names: str) -> Graph:
        """The same graph with tables (all without names) written once, for views that many steps read."""
        from quillgraph.operators.closure import durable

        return self.only(**{n: durable(self.spark, df, n) for n, df in self.tables.items() if not names or n in names})

    @property
    def nodes(self) -> DataFrame:
        return self.table("nodes")

    @cached_property
    def ancestry(self) -> DataFrame:
        """(file, anc, desc, depth) of all strict ancestors."""
        from quillgraph.operators.closure import ancestors

        return ancestors(self.spark, self.nodes.select("file", "id", "parent_id", "function_id"))

    def _once(self, df: DataFrame, name: str) -> DataFrame:
        from quillgraph.operators.closure import durable

        return durable(self.spark, df, name)

    @cached_property
    def flow_facts(self) -> DataFrame:
        """Control-flow facts of all functions; see operators.cfg."""
        from quillgraph.operators.cfg import facts

        return self._once(facts(self.spark, self.table("blocks"), self.table("cfg_edges")), "flow")

    @cached_property
    def feasible_facts(self) -> DataFrame:
        """``flow_facts`` without the arms that a constant condition rules out."""
        from quillgraph.operators.analyses import feasible_edges
        from quillgraph.operators.cfg import facts

        return self._once(facts(self.spark, self.table("blocks"), feasible_edges(self)), "feasible")

    @cached_property
    def constants(self) -> DataFrame:
        """(file, node, value) of constant expressions."""
        from quillgraph.operators.analyses import constants

        return self._once(constants(self), "constants")

    @cached_property
    def sizes(self) -> DataFrame:
        """(file, node, size_int, size_expr) of what has a size."""
        from quillgraph.operators.analyses import sizes

        return self._once(sizes(self), "sizes")

    @cached_property
    def nullability(self) -> DataFrame:
        """(file, node, source) of what may be null."""
        from quillgraph.operators.analyses import nullability

        return self._once(nullability(self), "nullability")

"""SQL fragments as Spark and as DuckDB write them, so that one definition of an expression serves the engine and its oracle."""

from __future__ import annotations


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


class Spark:
    name = "spark"

    def text(self, s): return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    def re_all(self, s, p): return f"regexp_extract_all({s}, r'{p}', 0)"
    def re_sub(self, s, p, r): return f"regexp_replace({s}, r'{p}', '{r}')"
    def re_test(self, s, p): return f"({s} rlike r'{p}')"
    def group(self, n): return f"${n}"
    def split(self, s, p): return f"split({s}, r'{p}')"
    def chars(self, s): return f"filter(split({s}, ''), z -> z <> '')"
    def transform(self, a, v, body): return f"transform({a}, {v} -> {body})"
    def transform_i(self, a, v, i, body): return f"transform({a}, ({v}, {i}) -> {body})"
    first_index = 0
    def filter(self, a, v, body): return f"filter({a}, {v} -> {body})"
    def any(self, a, v, body): return f"exists({a}, {v} -> {body})"
    def fold(self, a, init, acc, x, body): return f"aggregate({a}, {init}, ({acc}, {x}) -> {body})"
    def array(self, *items): return f"array({', '.join(items)})"
    def empty(self): return "cast(array() as array<string>)"
    def struct(self, **f): return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in f.items()) + ")"
    def contains(self, a, x): return f"array_contains({a}, {x})"
    def overlap(self, a, b): return f"arrays_overlap({a}, {b})"
    def common(self, a, b): return f"array_intersect({a}, {b})"
    def minus(self, a, b): return f"array_except({a}, {b})"
    def distinct(self, a): return f"sort_array(array_distinct({a}))"
    def size(self, a): return f"cast(size({a}) as bigint)"
    def at(self, a, i): return f"try_element_at({a}, cast({i} as int))"
    def slice(self, a, i, n): return f"slice({a}, {i}, {n})"
    def after_first(self, a): return f"slice({a}, 2, greatest(size({a}), 1))"
    def numbers(self, n): return f"(SELECT id AS k FROM range({n}))"
    def append(self, a, x): return f"array_append({a}, {x})"
    def join(self, a, sep): return f"array_join({a}, {sep})"
    def has(self, s, part): return f"contains({s}, {part})"
    def starts(self, s, part): return f"startswith({s}, {part})"
    def pos_explode(self, a, pos, v): return f"posexplode({a}) AS ({pos}, {v})"
    def explode(self, a, v): return f"explode({a}) AS {v}"
    def collect(self, x, *order): return f"transform(sort_array(collect_list(struct({', '.join(order)}, {x} AS __x))), s -> s.__x)"
    def long(self, x): return f"cast({x} as bigint)"
    def int_of(self, x): return f"try_cast({x} as bigint)"
    def translate(self, s, a, b): return f"translate({s}, {a}, {b})"
    def sum_sorted(self, x): return f"aggregate(sort_array(collect_list({x})), 0D, (a, b) -> a + b)"
    def dot(self, a, b): return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)"
    def micros(self, t): return f"unix_micros(cast({t} as timestamp))"
    def count_if(self, c): return f"count_if({c})"
    def max_by(self, x, *by): return f"max_by({x}, struct({', '.join(by)}))"
    def chr(self, n): return f"char({n})"
    def hash(self, s): return f"md5({s})"
    def values(self, rows, cols): return f"(SELECT * FROM VALUES {rows} AS v({cols}))"
    recursive = "WITH RECURSIVE"


class Duck:
    name = "duckdb"

    def text(self, s): return "'" + s.replace("'", "''") + "'"
    def re_all(self, s, p): return f"regexp_extract_all({s}, '{p}')"
    def re_sub(self, s, p, r): return f"regexp_replace({s}, '{p}', '{r}', 'g')"
    def re_test(self, s, p): return f"regexp_matches({s}, '{p}')"
    def group(self, n): return f"\\{n}"
    def split(self, s, p): return f"regexp_split_to_array({s}, '{p}')"
    def chars(self, s): return f"list_filter(string_split({s}, ''), lambda z: z <> '')"
    def transform(self, a, v, body): return f"list_transform({a}, lambda {v}: {body})"
    def transform_i(self, a, v, i, body): return f"list_transform({a}, lambda {v}, {i}: {body})"
    first_index = 1
    def filter(self, a, v, body): return f"list_filter({a}, lambda {v}: {body})"
    def any(self, a, v, body): return f"(len(list_filter({a}, lambda {v}: {body})) > 0)"
    def fold(self, a, init, acc, x, body): return f"list_reduce({a}, lambda {acc}, {x}: {body}, {init})"
    def array(self, *items): return f"[{', '.join(items)}]"
    def empty(self): return "[]::VARCHAR[]"
    def struct(self, **f): return "{" + ", ".join(f"'{k}': {v}" for k, v in f.items()) + "}"
    def contains(self, a, x): return f"list_contains({a}, {x})"
    def overlap(self, a, b): return f"list_has_any({a}, {b})"
    def common(self, a, b): return f"list_filter(list_distinct({a}), lambda q: list_contains({b}, q))"
    def minus(self, a, b): return f"list_filter({a}, lambda q: NOT list_contains({b}, q))"
    def distinct(self, a): return f"list_sort(list_distinct({a}))"
    def size(self, a): return f"len({a})::BIGINT"
    def at(self, a, i): return f"({a})[{i}]"
    def slice(self, a, i, n): return f"({a})[{i}:({i}) + ({n}) - 1]"
    def after_first(self, a): return f"({a})[2:]"
    def numbers(self, n): return f"(SELECT range AS k FROM range({n}))"
    def append(self, a, x): return f"list_append({a}, {x})"
    def join(self, a, sep): return f"coalesce(array_to_string({a}, {sep}), '')"
    def has(self, s, part): return f"contains({s}, {part})"
    def starts(self, s, part): return f"starts_with({s}, {part})"
    def pos_explode(self, a, pos, v): return f"unnest(range(len({a}))) AS {pos}, unnest({a}) AS {v}"
    def explode(self, a, v): return f"unnest({a}) AS {v}"
    def collect(self, x, *order): return f"list({x} ORDER BY {', '.join(order)})"
    def long(self, x): return f"({x})::BIGINT"
    def int_of(self, x): return f"TRY_CAST({x} AS BIGINT)"
    def translate(self, s, a, b): return f"translate({s}, {a}, {b})"
    def sum_sorted(self, x): return f"list_reduce(list({x} ORDER BY {x}), lambda a, b: a + b, 0::DOUBLE)"
    def dot(self, a, b): return f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: ({a})[i]::DOUBLE * ({b})[i]::DOUBLE), lambda s, v: s + v, 0::DOUBLE)"
    def micros(self, t): return f"epoch_us({t})"
    def count_if(self, c): return f"count(*) FILTER ({c})"
    def max_by(self, x, *by): return f"arg_max({x}, ({', '.join(by)}))"
    def chr(self, n): return f"chr({n})"
    def hash(self, s): return f"md5({s})"
    def values(self, rows, cols): return f"(SELECT * FROM (VALUES {rows}) AS v({cols}))"
    recursive = "WITH RECURSIVE"


SPARK, DUCK = Spark(), Duck()

"""Predicates over a JSON text `j`, written once for Spark SQL and for DuckDB's SQL."""

from __future__ import annotations


def _list(x) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in x)


class Spark:
    name = "spark"

    def part(self, path: str) -> str:
        return f"get_json_object(j, '{path}')" if path != "$" else "j"

    text = part

    def keys(self, path: str) -> str:
        return f"coalesce(json_object_keys({self.part(path)}), cast(array() as array<string>))"

    def has(self, path: str, *names: str) -> str:
        return f"arrays_overlap({self.keys(path)}, array({_list(names)}))"

    def array_length(self, path: str) -> str:
        return f"coalesce(json_array_length({self.part(path)}), 0)"

    def unlike_keys(self, path: str, names) -> str:
        """How many members have none of the names among their keys."""
        return f"size(map_filter(from_json(coalesce({self.part(path)}, '{{}}'), 'map<string,string>'), (k, v) -> not arrays_overlap(coalesce(json_object_keys(v), cast(array() as array<string>)), array({_list(names)}))))"

    def size(self, x: str) -> str:
        return f"size({x})"

    def words_but(self, x: str, names) -> str:
        return f"size(filter(split(trim({x}), ' +'), w -> w not in ({_list(names)})))"

    def number(self, path: str) -> str:
        return f"try_cast({self.text(path)} as double)"

    def matches(self, x: str, regex: str) -> str:
        return f"{x} rlike '{regex}'"


class Duck(Spark):
    name = "duck"

    def part(self, path: str) -> str:
        return f"json_extract(j, '{path}')"

    def text(self, path: str) -> str:
        return f"json_extract_string(j, '{path}')"

    def keys(self, path: str) -> str:
        return f"coalesce(case when json_type(j, '{path}') = 'OBJECT' then json_keys(j, '{path}') end, [])"

    def has(self, path: str, *names: str) -> str:
        return f"(len(list_intersect({self.keys(path)}, [{_list(names)}])) > 0)"

    def array_length(self, path: str) -> str:
        return f"coalesce(case when json_type(j, '{path}') = 'ARRAY' then json_array_length(j, '{path}') end, 0)"

    def unlike_keys(self, path: str, names) -> str:
        return f"len([k for k in {self.keys(path)} if len(list_intersect(json_keys(json_extract(j, '{path}.' || k)), [{_list(names)}])) = 0])"

    def size(self, x: str) -> str:
        return f"len({x})"

    def words_but(self, x: str, names) -> str:
        return f"len([w for w in string_split_regex(trim({x}), ' +') if w not in ({_list(names)})])"

    def matches(self, x: str, regex: str) -> str:
        return f"regexp_matches({x}, '{regex}')"

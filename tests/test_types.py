import pytest

from notegrid.types import compile_types

RAW = {
    "types": {
        "goal": {"output_dir": "Goals", "fields": {"status": {"kind": "select", "options": ["a", "b"], "required": True}}},
        "task": {"extends": "goal", "recursive": True, "traits": ["dated"],
                 "fields": {"status": {"default": "a"}, "due": {"kind": "date", "required": True}}},
        "step": {"extends": "task", "fields": {"status": {"options": ["c"]}}},
    },
    "traits": {"dated": {"fields": {"due": {"kind": "date", "granularity": "month"}, "status": {"kind": "text"}}}},
}


def test_nearest_definition_wins_and_traits_replace():
    s = compile_types(RAW)
    assert s.fields["task"]["status"] == {"default": "a"}          # own replaces a trait's field
    assert s.fields["task"]["due"] == {"kind": "date", "required": True}
    assert s.fields["step"]["status"] == {"default": "a", "options": ["c"]}  # own merges over inherited
    assert s.fields["task"]["parent"]["source"] == ["task"]         # implied by recursive


def test_families_and_qualified_names():
    s = compile_types(RAW)
    assert s.family("goal") == ["goal", "task", "step"]
    assert s.resolve_name("goal/task") == "task" and s.resolve_name("step/task") is None
    assert s.output_dir["task"] == "Goals/tasks"


def test_inheritance_ring_is_refused():
    with pytest.raises(ValueError, match="cycle"):
        compile_types({"types": {"a": {"extends": "b"}, "b": {"extends": "a"}}})

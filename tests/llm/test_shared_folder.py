from tests.test_plain_session import run


def test_written_tables_need_no_setting(tmp_path):
    body = """
from tallyloom.llm import queries
print(queries.queries()["op9_line_dedup"](spark, "/root/testdata/sf0.001").count() > 0)
"""
    assert run(tmp_path, body).split()[-1] == "True"

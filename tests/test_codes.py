"""Code maps from XML with the odd cases."""


from tidewell.sources import codes

XML = """<?xml version="1.0" encoding="UTF-8"?><result>
<list><corp_code>00000001</corp_code><corp_name>주식회사 하나</corp_name><stock_code>005930</stock_code></list>
<list><corp_code>00000002</corp_code><corp_name>㈜ 둘 Inc.</corp_name><stock_code> </stock_code></list>
<list><corp_code>00000003</corp_code><corp_name>셋</corp_name><stock_code></stock_code></list>
<list><corp_code>00000004</corp_code><corp_name>(주)셋</corp_name></list>
<list><corp_code></corp_code><corp_name>nobody</corp_name><stock_code>000001</stock_code></list>
<list><corp_code>00000005</corp_code><corp_name>five &amp; co</corp_name><stock_code>12345</stock_code></list>
</result>"""


def test_codes_come_from_the_list_then_from_names_that_one_company_has(spark, tmp_path):
    (tmp_path / "codes.xml").write_text(XML)
    entries = codes.read_code_list(spark, f"file://{tmp_path}/codes.xml")
    assert entries.count() == 5
    listed = spark.createDataFrame([("005930", "other"), ("000020", "둘"), ("000030", "셋"), ("000040", "nobody"), ("000050", "Ｆｉｖｅ"), ("7", "하나"), ("000050", "five co.")], "code string, name string")
    got = {r.stock_code: (r.corp_code, r.by_name) for r in codes.code_map(entries, listed).collect()}
    assert got == {"005930": ("00000001", False), "000020": ("00000002", True), "000050": ("00000005", True)}

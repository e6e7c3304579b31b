import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


@pytest.mark.parametrize(
    ("text", "raws"),
    [
        ("Call 0015556679493 now", ["0015556679493"]), ("Tel: 0556/756 81 20\n0556/756 81 21", ["0556/756 81 20", "0556/756 81 21"]), ("cell 555 123 4567, Fax:5551234568, WhatsApp 555-123-4569", ["555 123 4567", "5551234568", "555-123-4569"]),
        ("موبايل: ٠٥٥٥١٢٣٤٥٦٧", ["05551234567"]), ("M: (555) 123-4567", ["(555) 123-4567"]), ("055 123 456", ["055 123 456"]), ("+49 555 123 4567 and 0555 123 4567", ["+49 555 123 4567"]), ("2010 - 2014 99005551234567", []), ("0123 4567", []), ("012345678901", []),
        ("Phone: 0555 123 4567\n2019 - 2021", ["0555 123 4567"]), ("03/2007 - 2008, 03.2007 - 2008", []), ("+966\n555 1358066", ["+966\n555 1358066"]), ("+1 555 749 9947\n179", ["+1 555 749 9947"]), ("Hotel 2010 - 2014", []), (None, None),
    ],
)
def test_all_phones(spark, text, raws):
    got = spark.createDataFrame([(text,)], "x string").select(T.all_phones(F.col("x"))).first()[0]
    assert (got and [r.raw for r in got]) == (raws or got)
    assert raws is None or len(got) == len(raws)

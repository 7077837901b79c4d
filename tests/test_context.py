from pyspark.sql import functions as F

from leafmill.plans import learner_queries as lq
from leafmill.session import table


def test_every_page_has_its_image(spark, sf):
    pages = table(spark, sf, "extracted_pages").where("page_text IS NOT NULL").select("page_id").distinct()
    near = lq.QUERIES["ref_j6_j7_context"](spark, sf).select(F.col("image_no").alias("page_id")).distinct()
    assert near.count() == pages.count() and pages.join(near, "page_id", "left_anti").count() == 0

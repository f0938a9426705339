from lectura.llm import decontaminate as dec

DENSE = (
    "What is 12 + 30 - 5 * 3?", "Solve 3x + 7 = 22 for x.", "Convert 5 miles 300 yards to km and m.", "Which of 17, 21, 33, 49 is prime?",
    "John paid $12.50 for 3 kg, Mary paid $8 for 2 kg, and Bob paid $20 for 7 kg; who paid 2.86 a kg?",
)


def _found(spark, docs):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(DENSE)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in dec.contaminated(d, i).collect()}


def test_verbatim_copies_of_items_with_few_words(spark):
    docs = [f"Some words before it. {t} And words behind it." for t in DENSE]
    assert _found(spark, docs) == {(k, k) for k in range(len(DENSE))}


def test_other_values_need_more_words(spark):
    docs = ["Now. What is 4 + 8 - 6 * 2? That.", "Now. Which of 18, 22, 34, 51 is prime? That.", "Now. Convert 9 miles 100 yards to km and m. That.", "Now. " + DENSE[4].replace("12.50", "14.75").replace("3 kg", "9 kg") + " That.", "What is 12 30", "paid for and who"]
    assert _found(spark, docs) == {(1, 3), (2, 2), (3, 4)}

"""quire: document, translation-store and page-geometry analytics as Spark DataFrame operators."""

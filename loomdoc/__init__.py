"""loomdoc: a document-intelligence engine written as Spark plans."""

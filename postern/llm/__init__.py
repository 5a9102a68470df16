"""Training-data operators over tables of documents, conversations and benchmark items."""

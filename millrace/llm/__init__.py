"""Training-data operations over tables of documents and vectors."""

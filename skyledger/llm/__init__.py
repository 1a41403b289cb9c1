"""Training-data operators: the ten text and embedding jobs and the helpers they share."""

"""DataFrame operators: chunking, embedding, retrieval, prompts, answers, evaluation."""

"""Where logs come from: tables, blobs, polled pages, memory."""

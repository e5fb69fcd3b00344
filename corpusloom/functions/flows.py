"""Where untrusted data enters, where it does harm, and the chains of both."""

# Of each language the calls and words by which data enters, in order (the first that fits decides), and its kind.
SOURCES = {
    "python": [
        ("request.args.get", "http_param"),
        ("request.form.get", "http_param"),
        ("request.json", "http_body"),
        ("request.get_json", "http_body"),
        ("request.data", "http_body"),
        ("request.GET.get", "http_param"),
        ("request.POST.get", "http_param"),
        ("open", "file_read"),
        ("Path.read_text", "file_read"),
        ("os.environ", "env_read"),
        ("os.getenv", "env_read"),
        ("input", "stdin"),
        ("sys.stdin.read", "stdin"),
        ("sys.argv", "cli_arg"),
        ("socket.recv", "network_recv"),
        ("requests.get", "network_recv"),
    ],
    "javascript": [
        ("req.query", "http_param"),
        ("req.params", "http_param"),
        ("req.body", "http_body"),
        ("req.cookies", "http_param"),
        ("process.env", "env_read"),
        ("process.argv", "cli_arg"),
        ("fs.readFile", "file_read"),
        ("fs.readFileSync", "file_read"),
        ("window.location", "http_param"),
        ("document.cookie", "http_param"),
    ],
    "go": [
        ("r.URL.Query().Get", "http_param"),
        ("r.FormValue", "http_param"),
        ("r.PostFormValue", "http_param"),
        ("r.Body", "http_body"),
        ("r.Header.Get", "http_param"),
        ("os.Getenv", "env_read"),
        ("os.Args", "cli_arg"),
        ("flag.Args", "cli_arg"),
        ("os.ReadFile", "file_read"),
        ("ioutil.ReadFile", "file_read"),
        ("bufio.NewReader", "stdin"),
        ("fmt.Scan", "stdin"),
        ("http.Get", "network_recv"),
    ],
    "java": [
        ("request.getParameter", "http_param"),
        ("request.getHeader", "http_param"),
        ("request.getInputStream", "http_body"),
        ("request.getReader", "http_body"),
        ("request.getQueryString", "http_param"),
        ("System.getenv", "env_read"),
        ("System.getProperty", "env_read"),
        ("args[", "cli_arg"),
        ("new Scanner(System.in)", "stdin"),
        ("Files.readAllBytes", "file_read"),
        ("FileInputStream", "file_read"),
        ("BufferedReader", "file_read"),
    ],
    "ruby": [
        ("params[", "http_param"),
        ("request.params", "http_param"),
        ("request.env", "http_param"),
        ("request.body", "http_body"),
        ("ENV[", "env_read"),
        ("ARGV", "cli_arg"),
        ("File.read", "file_read"),
        ("File.open", "file_read"),
        ("IO.read", "file_read"),
        ("gets", "stdin"),
        ("STDIN.gets", "stdin"),
        ("Net::HTTP.get", "network_recv"),
    ],
    "php": [
        ("$_GET", "http_param"),
        ("$_POST", "http_param"),
        ("$_REQUEST", "http_param"),
        ("$_SERVER", "http_param"),
        ("$_COOKIE", "http_param"),
        ("$_FILES", "http_body"),
        ("file_get_contents", "file_read"),
        ("fread", "file_read"),
        ("getenv", "env_read"),
        ("$_ENV", "env_read"),
        ("$argv", "cli_arg"),
        ("php://input", "http_body"),
        ("curl_exec", "network_recv"),
    ],
    "rust": [
        ("std::env::args", "cli_arg"),
        ("std::env::var", "env_read"),
        ("std::fs::read", "file_read"),
        ("std::fs::read_to_string", "file_read"),
        ("std::io::stdin().read_line", "stdin"),
        ("reqwest::get", "network_recv"),
        ("warp::query", "http_param"),
        ("actix_web::web::Query", "http_param"),
    ],
    "c": [
        ("fopen", "file_read"),
        ("fread", "file_read"),
        ("read(", "file_read"),
        ("getenv", "env_read"),
        ("argv", "cli_arg"),
        ("scanf", "stdin"),
        ("fgets", "stdin"),
        ("gets(", "stdin"),
        ("recv(", "network_recv"),
        ("recvfrom", "network_recv"),
    ],
    "csharp": [
        ("Request.QueryString", "http_param"),
        ("Request.Form", "http_param"),
        ("Request.Params", "http_param"),
        ("HttpContext.Request", "http_param"),
        ("Console.ReadLine", "stdin"),
        ("Environment.GetEnvironmentVariable", "env_read"),
        ("File.ReadAllBytes", "file_read"),
        ("File.ReadAllText", "file_read"),
        ("Environment.GetCommandLineArgs", "cli_arg"),
        ("HttpClient.GetAsync", "network_recv"),
    ],
    "shell": [
        ("$1", "cli_arg"),
        ("$@", "cli_arg"),
        ("$HOME", "env_read"),
        ("$USER", "env_read"),
        ("read ", "stdin"),
        ("$(curl ", "network_recv"),
        ("$(wget ", "network_recv"),
    ],
}

# Of each language the calls and words that do harm with what they get, in order, and the kind of harm.
SINKS = {
    "python": [
        ("os.system", "command_exec"),
        ("subprocess.call", "command_exec"),
        ("subprocess.run", "command_exec"),
        ("subprocess.Popen", "command_exec"),
        ("subprocess.check_output", "command_exec"),
        ("subprocess.check_call", "command_exec"),
        ("eval", "code_exec"),
        ("exec", "code_exec"),
        ("compile", "code_exec"),
        ("pickle.load", "deserialize"),
        ("pickle.loads", "deserialize"),
        ("yaml.load", "deserialize"),
        ("marshal.loads", "deserialize"),
        ("cursor.execute", "sql_exec"),
        ("connection.execute", "sql_exec"),
        ("requests.post", "network_send"),
        ("requests.put", "network_send"),
        ("socket.send", "network_send"),
        ("open.*w", "file_write"),
    ],
    "javascript": [
        ("child_process.exec", "command_exec"),
        ("child_process.spawn", "command_exec"),
        ("child_process.execSync", "command_exec"),
        ("exec(", "command_exec"),
        ("spawn(", "command_exec"),
        ("eval", "code_exec"),
        ("Function(", "code_exec"),
        ("new Function", "code_exec"),
        ("setTimeout(", "code_exec"),
        ("setInterval(", "code_exec"),
        ("innerHTML", "html_output"),
        ("dangerouslySetInnerHTML", "html_output"),
        ("document.write", "html_output"),
        ("fetch", "network_send"),
        ("axios.post", "network_send"),
        ("axios.put", "network_send"),
        ("XMLHttpRequest", "network_send"),
    ],
    "go": [
        ("exec.Command", "command_exec"),
        ("os.StartProcess", "command_exec"),
        ("syscall.Exec", "command_exec"),
        ("db.Query", "sql_exec"),
        ("db.Exec", "sql_exec"),
        ("db.QueryRow", "sql_exec"),
        ("json.Unmarshal", "deserialize"),
        ("yaml.Unmarshal", "deserialize"),
        ("gob.NewDecoder", "deserialize"),
        ("http.Post", "network_send"),
        ("http.Get", "network_send"),
        ("net.Dial", "network_send"),
        ("os.WriteFile", "file_write"),
        ("ioutil.WriteFile", "file_write"),
        ("template.HTML", "html_output"),
    ],
    "java": [
        ("Runtime.getRuntime().exec", "command_exec"),
        ("ProcessBuilder", "command_exec"),
        ("ProcessBuilder.start", "command_exec"),
        ("Statement.execute", "sql_exec"),
        ("Statement.executeQuery", "sql_exec"),
        ("PreparedStatement", "sql_exec"),
        ("createStatement", "sql_exec"),
        ("ObjectInputStream", "deserialize"),
        ("readObject", "deserialize"),
        ("XMLDecoder", "deserialize"),
        ("ScriptEngine.eval", "code_exec"),
        ("new URL", "network_send"),
        ("HttpURLConnection", "network_send"),
        ("Socket", "network_send"),
        ("FileWriter", "file_write"),
        ("FileOutputStream", "file_write"),
    ],
    "ruby": [
        ("system(", "command_exec"),
        ("exec(", "command_exec"),
        ("spawn(", "command_exec"),
        ("%x(", "command_exec"),
        ("`", "command_exec"),
        ("eval(", "code_exec"),
        ("send(", "code_exec"),
        ("instance_eval", "code_exec"),
        ("class_eval", "code_exec"),
        ("YAML.load", "deserialize"),
        ("Marshal.load", "deserialize"),
        ("Net::HTTP", "network_send"),
        ("RestClient.post", "network_send"),
        ("File.write", "file_write"),
    ],
    "php": [
        ("exec(", "command_exec"),
        ("system(", "command_exec"),
        ("shell_exec(", "command_exec"),
        ("passthru(", "command_exec"),
        ("proc_open(", "command_exec"),
        ("popen(", "command_exec"),
        ("eval(", "code_exec"),
        ("assert(", "code_exec"),
        ("create_function", "code_exec"),
        ("mysql_query(", "sql_exec"),
        ("mysqli_query(", "sql_exec"),
        ("pg_query(", "sql_exec"),
        ("unserialize(", "deserialize"),
        ("include(", "code_exec"),
        ("require(", "code_exec"),
        ("curl_exec", "network_send"),
        ("file_put_contents", "file_write"),
        ("header(", "html_output"),
    ],
    "rust": [
        ("std::process::Command::new", "command_exec"),
        ("Command::new", "command_exec"),
        (".output()", "command_exec"),
        ("std::process::Command::output", "command_exec"),
        ("serde_json::from_str", "deserialize"),
        ("serde_yaml::from_str", "deserialize"),
        ("std::net::TcpStream::connect", "network_send"),
        ("reqwest::Client.post", "network_send"),
        ("std::fs::write", "file_write"),
        ("unsafe", "code_exec"),
    ],
    "c": [
        ("system(", "command_exec"),
        ("popen(", "command_exec"),
        ("exec", "command_exec"),
        ("dlopen", "code_exec"),
        ("dlsym", "code_exec"),
        ("strcpy(", "code_exec"),
        ("strcat(", "code_exec"),
        ("sprintf(", "code_exec"),
        ("send(", "network_send"),
        ("sendto(", "network_send"),
        ("fprintf", "file_write"),
        ("fwrite", "file_write"),
        ("write(", "file_write"),
    ],
    "csharp": [
        ("Process.Start", "command_exec"),
        ("Process.StartInfo", "command_exec"),
        ("SqlCommand", "sql_exec"),
        ("SqlDataAdapter", "sql_exec"),
        ("ExecuteNonQuery", "sql_exec"),
        ("ExecuteReader", "sql_exec"),
        ("JavaScriptSerializer.Deserialize", "deserialize"),
        ("BinaryFormatter.Deserialize", "deserialize"),
        ("XmlSerializer.Deserialize", "deserialize"),
        ("Assembly.Load", "code_exec"),
        ("WebClient.DownloadString", "network_send"),
        ("HttpClient.PostAsync", "network_send"),
        ("HttpClient.PutAsync", "network_send"),
        ("File.WriteAllBytes", "file_write"),
        ("File.WriteAllText", "file_write"),
    ],
    "shell": [
        ("eval ", "code_exec"),
        ("curl ", "network_send"),
        ("wget ", "network_send"),
        ("curl.*|.*sh", "command_exec"),
        ("wget.*|.*sh", "command_exec"),
        ("nc ", "network_send"),
        ("> /etc/", "file_write"),
        ("source ", "code_exec"),
        ("chmod +s", "command_exec"),
        ("chown ", "command_exec"),
    ],
}

# Words that make data safe, calls that bring data into a line of their own, rounds of propagation.
SANITIZERS = ["shlex.quote", "escape", "sanitize", "validate", "isinstance", "isdigit", "isalnum", "re.match", "bleach.clean", "html.escape", "markupsafe"]
DIRECT_USES = ["request.args", "request.form", "request.json", "os.environ", "sys.argv", "input()"]
ROUNDS = 5
# Confidence of a path, of a sanitised one, and of one whose source stands in the sink's own arguments.
PLAIN, SANITISED, INLINE = 0.85, 0.3, 0.6

# Of each chain its name, severity, source kinds, words on the source's line, words between, sink kinds, words on the sink's line.
CHAINS = [
    ("Download & Execute", "critical", ["network_recv", "http_param", "file_read"], [], ["decode", "base64", "b64decode", "fromhex", "atob", "decrypt", "decompress", "unzip"], ["command_exec", "code_exec", "deserialize"], []),
    ("Credential Theft & Exfil", "critical", ["env_read", "file_read"], ["password", "secret", "token", "key", "credential", ".env", ".ssh", ".aws"], [], ["network_send"], []),
    ("Persistence via Scheduled Task", "critical", ["file_read", "network_recv"], [], [], ["file_write"], ["cron", "systemd", "launchd", "Startup", "registry", "bashrc", "profile", "autostart"]),
    ("Privilege Escalation", "high", [], [], ["sudo", "chmod", "setuid", "SeImpersonatePrivilege", "runas"], ["command_exec", "file_write"], []),
    ("Data Exfiltration", "high", ["file_read", "env_read"], [], ["encode", "base64", "b64encode", "btoa", "encrypt", "compress", "zip"], ["network_send"], []),
    ("Dynamic Code Injection", "critical", ["network_recv", "http_param", "file_read"], [], ["decode", "base64", "eval", "compile", "exec"], ["code_exec"], []),
]
